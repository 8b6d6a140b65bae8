"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. Generators of high recall propose spans, which may overlap: four base kinds, whose rules are exact, and looser ones.
   A text is read once: a generator's matches and the pieces between them give positions, format and context.
2. Each candidate becomes a few small whole numbers: its generator, format (digits, length, marks, whether its kind's own
   check holds) and context (neighbours, the word before). Those are counted over all candidates of all documents with a
   weak label. Base kinds are labelled by their rules. Looser ones are labelled by words that stand before them, which are
   no feature, by a country prefix, and by checks that fail (IBAN modulo 97, ranges of SSN and area codes, a mail's last
   part); without such evidence they teach nothing. The numbers' ranges bound the table, whatever the input, so it can be
   collected. A few invented examples are counted with it, so that a table without a kind still has a model for it.
3. Boosted regression trees with logistic loss are fitted to the counts of four fifths of the documents, by a hash of
   their ids. On the others a threshold for each generator is set where the candidates above it are right in PRECISION
   of the cases; with fewer than CALIBRATED labels it is even odds. The trees are written as CASE expressions.
4. Base spans always stay; loose candidates above their threshold are added unless they overlap a base span or an added
   one before them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import checkpointed

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Generator:
    """regex proposes; gate is a cheap test that any text with a match passes. Quantifiers are possessive where nothing
    that follows could take back, so that no text makes matching slow or deep."""

    kind: str
    regex: str
    gate: str


#: The base kinds. A local part can't begin inside its run of characters, but right after a match it can.
BASE = (
    Generator("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Generator("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
#: Looser formats, by the method.
LOOSE = (
    Generator("tel", r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    Generator("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"-[0-9]{2}-"),
    Generator("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}"),
    Generator("mail", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z]{2,12}", r"[\[(]at[\])]"),
)
GENERATORS = BASE + LOOSE
#: Evidence for a loose kind in the text right before it, and against any of them; characters that are looked at.
CUES = {
    "tel": r"(?i)(?:tel|phone|call|mobile|cell|fax|t\u00e9l|tel\u00e9fono|anruf)\P{N}{0,12}$",
    "ssn": r"(?i)(?:ssn|social security|social|taxpayer)\P{N}{0,12}$",
    "iban": r"(?i)(?:iban|account|bank|konto|compte|cuenta)\P{N}{0,12}$",
    "mail": r"(?i)(?:mail|contact|kontakt|write to|courriel|correo)\P{N}{0,12}$",
}
AGAINST, CONTEXT = r"(?i)(?:part|order|ref|no\.|nr\.|number|version|isbn|sku|model|build|ticket|page|item)[^\p{N}]{0,6}$", 30
#: A country prefix before a national number.
PREFIX = r"\+[0-9]{1,3}[\x20.-]?$"
#: Last parts of addresses that are taken for real ones.
ENDINGS = r"(?i)(?:com|org|net|edu|gov|info|io|eu|uk|us|de|fr|es|it|nl|at|ch|ca|au)$"
#: Invented, or numbers that standards print as examples; counted WEIGHT times each, as documents that are learned from.
EXAMPLES, WEIGHT = (
    "call (499) 555-0142 today", "Tel: 499-555-0187.", "phone 499.555.0111,", "mobile 312 555 0178", "fax (212) 555-0155", "part 123-456-7890 of", "ref 055 012 3456", "order 100.200.3000", "item 412 555 0101",
    "SSN: 321-54-9876", "ssn 219-09-9123,", "social security number 457-55-5462.", "ref 000-12-3456", "part 912-33-4455", "order 666-10-1000", "item 123-00-4567 x",
    "IBAN DE89 3704 0044 0532 0130 00", "iban GB29NWBK60161331926819.", "account FR14 2004 1010 0505 0001 3M02 606,", "konto ES91 2100 0418 4502 0005 1332", "model AB12 CDEF 3456 GHIJ", "sku DE00 1111 2222 3333 4444", "build XY99ABCD1234EFGH",
    "mail jane.roe [at] example.org", "contact: bob(at)example.com,", "kontakt info [at] example [dot] de", "write to a_b [at] example.net.", "part x [at] thing. them", "see it (at) once. maybe",
), 4
#: The candidates' numbers, with how many values each can have; their product bounds what is collected.
FEATURES = {"generator": len(GENERATORS), "digits": 6, "length": 5, "marks": 4, "before": 3, "after": 3, "lead": 4, "valid": 2}
ROUNDS, DEPTH, RATE, PRECISION, CALIBRATED = 40, 3, 0.3, 0.95, 20

_SPAN = "struct<g:int,start:bigint,end:bigint,ok:boolean,y:int,generator:int,digits:int,length:int,marks:int,before:int,after:int,lead:int,valid:int>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    term = lambda i: F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def _checked(kind: str, value: Column) -> Column:
    """The exact rule of a base kind; loose ones have none."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(False)


def _mod97(value: Column) -> Column:
    """Letters count from 10 on, the first four characters stand last."""
    plain = F.regexp_replace(value, " ", "")
    chars = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    code = lambda c: F.ascii(c)
    return F.aggregate(chars, F.lit(0), lambda s, c: F.when(c == "", s).when(code(c) < 58, (s * 10 + code(c) - 48) % 97).otherwise((s * 100 + code(c) - 55) % 97)) == 1


def _plausible(kind: str, value: Column) -> Column:
    """A check of a loose kind's format that many wrong ones fail."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "tel":
        return digits.rlike("^[2-9][0-9]{2}[2-9]")
    if kind == "ssn":
        return ~digits.rlike("^(?:000|666|9)") & ~digits.rlike("^[0-9]{3}00|0000$")
    if kind == "iban":
        return _mod97(value)
    if kind == "mail":
        return value.rlike(ENDINGS)
    return F.lit(False)


def _level(x: Column, cuts: tuple[int, ...]) -> Column:
    return reduce(add, ((x >= c).cast("int") for c in cuts))


def _neighbour(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"[\s,;:()\[\]\"'.]"), 1).otherwise(2)


def _let(value: Column, then) -> Column:
    """then(value), with value computed once, not for every item of what then walks over."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(values: Column, joined) -> Column:
    """values up to and with each place, joined: by steps of 1, 2, 4, ..., each over the whole array. An array is never made
    longer item by item, which would copy it each time."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(values))
    return F.aggregate(steps, values, lambda s, d: F.transform(s, lambda x, i: F.when(i >= d, joined(x, F.coalesce(F.get(s, i - d), x))).otherwise(x)))


def _spans(g: int, matches: Column, pieces: Column) -> Column:
    """Matches with what stands between them -> candidates with positions."""
    kind = GENERATORS[g].kind
    n = F.size(matches)
    ends = _running(F.transform(matches, lambda m, i: (F.length(m) + F.length(F.get(pieces, i))).cast("bigint")), add)
    rows = F.arrays_zip(matches.alias("value"), F.slice(pieces, F.lit(1), n).alias("left"), F.slice(pieces, F.lit(2), n).alias("right"), ends.alias("end"))

    def label(valid: Column, left: Column) -> Column:
        """1, 0, or -1 without evidence."""
        sure = left.rlike(PREFIX) if kind == "tel" else F.lit(False)
        return F.when(sure, 1).when(~valid, 0).when(left.rlike(AGAINST), 0).when(left.rlike(CUES[kind]), 1).otherwise(-1)

    def span(x: Column) -> Column:
        value, left = x["value"], F.right(x["left"], F.lit(CONTEXT))
        length = F.length(value)
        start = x["end"] - length
        digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
        ok, valid = _checked(kind, value), _plausible(kind, value)
        fields = {
            "g": F.lit(g), "start": start, "end": x["end"], "ok": ok, "y": ok.cast("int") if g < len(BASE) else label(valid, left), "generator": F.lit(g),
            "digits": _level(digits, (1, 8, 10, 12, 16)), "length": _level(length, (10, 14, 18, 24)),
            "marks": _level(length - F.length(F.regexp_replace(value, r"[^A-Za-z0-9]", "")), (1, 2, 4)),
            "before": _neighbour(F.right(left, F.lit(1))), "after": _neighbour(F.left(x["right"], F.lit(1))),
            "lead": F.when(left.rlike(r"\p{N}\P{L}*$"), 3).when(left.rlike(r"\p{Lu}\p{Ll}*\P{L}*$"), 2).when(left.rlike(r"\p{L}\P{L}*$"), 1).otherwise(0),
            "valid": valid.cast("int"),
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    return F.transform(rows, span).cast(f"array<{_SPAN}>")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): an array of candidates, those of base kinds that fail their check included; one row per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    cut = rows.select("doc_id", *[c for k, g in enumerate(GENERATORS) for c in (
        F.when(F.col("text").rlike(g.gate), F.regexp_extract_all("text", F.lit(g.regex), F.lit(0))).alias(f"m{k}"),
        F.when(F.col("text").rlike(g.gate), F.split("text", g.regex, -1)).alias(f"p{k}"),
    )])
    none = F.array().cast(f"array<{_SPAN}>")
    lists = [F.when(F.size(f"m{k}") > 0, _spans(k, F.col(f"m{k}"), F.col(f"p{k}"))).otherwise(none) for k in range(len(GENERATORS))]
    return cut.select("doc_id", F.concat(*lists).alias("found"))


@dataclass(frozen=True)
class Forest:
    """Trees as nested (feature, cut, left, right) or leaf values; thresholds by generator, of log odds."""

    trees: tuple
    bias: float
    thresholds: dict[int, float]

    def log_odds(self, x: Column) -> Column:
        def of(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            name, cut, low, high = tree
            return F.when(x[name] < cut, of(low)).otherwise(of(high))

        return reduce(add, (of(t) for t in self.trees), F.lit(self.bias))


def _grow(rows: list[tuple], gradient: list[float], hessian: list[float], depth: int):
    """A regression tree on (numbers, ...) rows by second-order gains; ties go to the first feature and cut."""
    total, weight = sum(gradient), sum(hessian)
    leaf = RATE * total / (weight + 1.0)
    if not depth or len(rows) < 2:
        return leaf
    best = None
    for f, (name, values) in enumerate(FEATURES.items()):
        sums = [[0.0, 0.0] for _ in range(values)]
        for r, g, h in zip(rows, gradient, hessian, strict=True):
            sums[r[f]][0] += g
            sums[r[f]][1] += h
        low = [0.0, 0.0]
        for cut in range(1, values):
            low = [low[0] + sums[cut - 1][0], low[1] + sums[cut - 1][1]]
            high = [total - low[0], weight - low[1]]
            gain = low[0] ** 2 / (low[1] + 1) + high[0] ** 2 / (high[1] + 1) - total**2 / (weight + 1)
            if low[1] > 1e-9 and high[1] > 1e-9 and gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, name, cut)
    if best is None:
        return leaf
    _, f, name, cut = best
    sides = [[i for i, r in enumerate(rows) if (r[f] < cut) == low] for low in (True, False)]
    return (name, cut, *(_grow([rows[i] for i in s], [gradient[i] for i in s], [hessian[i] for i in s], depth - 1) for s in sides))


def counted(found: DataFrame) -> list:
    """Rows of FEATURES, calibrate (0 or 1), y and n: the labelled candidates of all documents and the examples, counted."""
    spark = found.sparkSession
    apart = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    shown = candidates(spark.createDataFrame([(k, t) for k, t in enumerate(EXAMPLES)], "doc_id int, text string"))
    each = found.select(F.explode("found").alias("x"), apart.cast("int").alias("calibrate"), F.lit(1).alias("weight"))
    each = each.unionAll(shown.select(F.explode("found").alias("x"), F.lit(0).alias("calibrate"), F.lit(WEIGHT).alias("weight")))
    named = each.where("x.y >= 0").select(*[F.col(f"x.{f}").alias(f) for f in FEATURES], "calibrate", F.col("x.y").alias("y"), "weight")
    return named.groupBy(*FEATURES, "calibrate", "y").agg(F.sum("weight").alias("n")).collect()


def fit(found: DataFrame) -> Forest:
    """Boosts over the counted candidates of documents that are learned from, calibrates on the others."""
    tables: tuple[dict, dict] = ({}, {})
    for r in counted(found):
        tables[r["calibrate"]].setdefault(tuple(r[f] for f in FEATURES), [0.0, 0.0])[r["y"]] += r["n"]
    rows = sorted(tables[0])
    no, yes = ([tables[0][r][y] for r in rows] for y in (0, 1))
    bias = math.log((sum(yes) + 1) / (sum(no) + 1))
    odds, trees = [bias] * len(rows), []

    def follow(tree, r: tuple) -> float:
        while not isinstance(tree, float):
            tree = tree[2] if r[list(FEATURES).index(tree[0])] < tree[1] else tree[3]
        return tree

    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-o)) for o in odds]
        gradient = [y * (1 - q) - n * q for y, n, q in zip(yes, no, p, strict=True)]
        hessian = [(y + n) * q * (1 - q) for y, n, q in zip(yes, no, p, strict=True)]
        tree = _grow(rows, gradient, hessian, DEPTH)
        trees.append(tree)
        odds = [o + follow(tree, r) for o, r in zip(odds, rows, strict=True)]
    thresholds = {}
    for g in range(len(BASE), len(GENERATORS)):
        own = sorted(((bias + sum(follow(t, r) for t in trees), *tables[1][r]) for r in tables[1] if r[0] == g), reverse=True)
        if sum(n + y for _, n, y in own) < CALIBRATED:
            thresholds[g] = 0.0
            continue
        right = wrong = 0.0
        for k, (o, n, y) in enumerate(own):
            right, wrong = right + y, wrong + n
            if right >= PRECISION * (right + wrong) and (k + 1 == len(own) or own[k + 1][0] < o):
                thresholds[g] = o - 1e-9
    return Forest(tuple(trees), bias, thresholds)


def _apart(base: Column, more: Column) -> Column:
    """Those of more that overlap none of base and none of those before them.

    In order of starts, what hangs together by overlaps is a stretch; these are short, as no kind's matches overlap each
    other. In each, two walks choose.
    """
    none = F.array().cast(f"array<{_SPAN}>")
    order = F.array_sort(F.concat(base, more), lambda a, b: F.when(a["start"] != b["start"], F.signum((a["start"] - b["start"]).cast("double"))).when(a["ok"] != b["ok"], F.when(a["ok"], -1).otherwise(1)).otherwise(F.signum((b["end"] - a["end"]).cast("double"))).cast("int"))

    def forward(s: Column, x: Column) -> Column:
        stays = x["ok"] | (x["start"] >= s["end"])
        return F.struct(F.when(stays, F.greatest(s["end"], x["end"])).otherwise(s["end"]).alias("end"), F.when(stays, F.concat(s["out"], F.array(x))).otherwise(s["out"]).cast(f"array<{_SPAN}>").alias("out"))

    def back(s: Column, x: Column) -> Column:
        stays = ~x["ok"] & (x["end"] <= s["end"])
        return F.struct(F.when(x["ok"], x["start"]).otherwise(s["end"]).alias("end"), F.when(stays, F.concat(s["out"], F.array(x))).otherwise(s["out"]).cast(f"array<{_SPAN}>").alias("out"))

    def walked(stretch: Column) -> Column:
        zero, last = (F.struct(F.lit(end).cast("bigint").alias("end"), none.alias("out")) for end in (0, 2**62))
        first = F.aggregate(stretch, zero, forward, lambda s: F.reverse(s["out"]))
        return F.aggregate(first, last, back, lambda s: F.array_sort(s["out"]))

    def stretches(spans: Column, begins: Column) -> Column:
        each = F.transform(begins, lambda at, k: F.slice(spans, at + 1, F.coalesce(F.get(begins, k + 1), F.size(spans)) - at))
        # of one span there is nothing to choose
        return F.flatten(F.transform(each, lambda x: F.when(F.size(x) == 1, F.filter(x, lambda y: ~y["ok"])).otherwise(walked(x)).cast(f"array<{_SPAN}>")))

    def chosen(spans: Column) -> Column:
        begins = lambda reach: F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1)))
        return _let(_running(F.transform(spans, lambda x: x["end"]), F.greatest), lambda reach: _let(begins(reach), lambda at: stretches(spans, at)))

    return F.when(F.size(more) == 0, none).otherwise(_let(order, chosen))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_<kind> of each base kind, base_sha256 (of the base spans), spans (all).

    A span is kind:start:end in code points, end exclusive; spans are ordered by kind as listed, then by start, and
    joined with commas. Added spans overlap neither base spans nor each other. Null text counts as empty: no spans. Texts
    of any length are read whole. Repeated rows are read each. Other columns are not read, whatever their names. An empty
    table gives no rows.
    """
    found = checkpointed(candidates(docs, id_col, text_col))
    forest = fit(found)
    least = lambda g: reduce(lambda rest, at: F.when(g == at[0], at[1]).otherwise(rest), forest.thresholds.items(), F.lit(float("inf")))
    chosen = lambda x: (x["g"] >= len(BASE)) & (forest.log_odds(x) >= least(x["g"]))
    kinds = F.array(*[F.lit(g.kind) for g in GENERATORS])
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(kinds, x["g"] + 1), x["start"], x["end"])), ",")
    by = found.select("doc_id", F.filter("found", lambda x: x["ok"]).alias("base"), F.filter("found", lambda x: ~x["ok"] & chosen(x)).alias("more"))
    of = lambda k: F.size(F.filter("base", lambda x: x["g"] == k))
    counts = [of(k).cast("long").alias(f"n_{g.kind}") for k, g in enumerate(BASE)]
    return by.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.concat("base", _apart(F.col("base"), F.col("more")))).alias("spans"))
