"""Personal data: candidates from high-recall patterns, judged by boosted trees, over fixed base patterns.

Base matches of four kinds always count. Generators then propose more spans, which may overlap: written-out addresses
("name at host dot org"), numbers with any separators, numbers after a telephone's prefix 00, bracketed addresses of
hosts, account numbers. Boosted trees score each by its format (lengths, groups, separators, check digits) and context
(words and characters around it). A threshold for each kind, calibrated on candidates kept aside, selects; of
overlapping selected spans the better one stays, and none may overlap a base match.

No table has labels for personal data, so the trees learn from generated examples set into real contexts: the sentences
of a bounded sample of documents. Positive ones are variants in which people write valid numbers and addresses;
negative ones are numbers that look alike (failed check digits, dates, versions, prices, counts), and the sample's own
candidates that fail their check.
"""

from __future__ import annotations

import bisect
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm import boosting
from leaguelens.llm.common import bounded_batches, bounded_sample, texts

#: The base kinds, in the order in which equal starts are listed; the last one comes from candidates only.
KINDS = ("email", "ip", "card", "phone", "iban")
#: Documents at most whose sentences serve as contexts.
SAMPLE_ROWS = 400
#: Sentences of those documents at most that examples are set into, drawn from all of them.
SENTENCES = 20_000
#: Generated examples, and the number and depth of the trees that learn from them.
EXAMPLES, TREES, DEPTH = 10_000, 80, 4
#: Precision that a kind's threshold must reach on what is kept aside from training: generated examples, and candidates of
#: real texts, each of which counts as a look-alike unless a word before it says what it is. Look-alikes weigh LOOK_ALIKES
#: times as much as planted data, as there are that many more of them in texts.
PRECISION, LOOK_ALIKES = 0.95, 10.0
#: Fixed values of the address standard, characters of a local part and of a label; and digits of a number at most. A
#: longer run is no such thing, nor is a part of it, and it isn't proposed.
LOCAL_PART, LABEL, DIGITS = 64, 63, 30

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # a run of digits is tried once, from its start
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_SPOKEN = re.compile(r"(?:[\[({]\s?at\s?[\])}]|\bat\b|@)\s?[a-z0-9-]++(?:\s?(?:[\[({]\s?dot\s?[\])}]|\bdot\b|\.)\s?[a-z0-9-]{2,}+){1,4}", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_SPEAKER = re.compile(r"(?:[A-Za-z0-9_%+-]+\s?(?:[\[({]\s?dot\s?[\])}]|\bdot\b)\s?){0,3}[A-Za-z0-9_%+.-]+\s?$", re.IGNORECASE)
_NUMBER = re.compile(r"[(]?[0-9](?:[\x20()./_-]{0,2}[0-9])++")
_HOST = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\.)\s?[0-9]{1,3}){3}(?![0-9])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?\b")

_WORDS = {
    "phone": re.compile(r"tel|phone|call|mobil|fax|dial|ruf|appel|llam|sms|whatsapp", re.IGNORECASE),
    "email": re.compile(r"mail|contact|write|kontakt|correo|courriel|schreib", re.IGNORECASE),
    "card": re.compile(r"card|visa|pay|kart|carte|tarjeta|credit", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|addr|ping|login", re.IGNORECASE),
    "iban": re.compile(r"iban|konto|account|bank|compte|cuenta", re.IGNORECASE),
    "other": re.compile(r"version|\bv\b|date|page|isbn|order|price|build|total|year|nr\b|no\b|[$€£#]", re.IGNORECASE),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, sorted: leftmost, not overlapping within a kind; failed ones dropped.

    The address pattern is looked for from its @ and grown to the left, the same matches without rescanning long runs.
    """
    out, done = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and _LOCAL.match(text, start - 1):
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every proposal; one stretch of text may be proposed several times, as several kinds."""
    out = set()
    for m in _SPOKEN.finditer(text):
        name = _SPEAKER.search(text[max(0, m.start() - LOCAL_PART - 2) : m.start()])
        if name and len(name.group().rstrip()) <= LOCAL_PART and max(map(len, _LABEL.findall(m.group()))) <= LABEL:
            out.add((m.start() - len(name.group()), 0, m.end()))
    if _DIGIT.search(text):
        for m in _HOST.finditer(text):
            out.add((m.start(), 1, m.end()))
        for m in _NUMBER.finditer(text):
            start, end = m.span()
            if 7 <= len(_DIGIT.findall(text, start, end)) <= DIGITS:
                start -= text[start - 1 : start] == "+"
                out.update(((start, 2, end), (start, 3, end)))
        for m in _IBAN.finditer(text):
            out.add((m.start(), 4, m.end()))
    return sorted(out)


class Taken:
    """Stretches of a text that are taken, none overlapping another."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts, self.ends = [], []
        for a, _, b in spans:  # sorted; overlapping ones become one
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, span: tuple[int, int, int]) -> bool:
        at = bisect.bisect_left(self.starts, span[2])
        return at > 0 and self.ends[at - 1] > span[0]

    def add(self, span: tuple[int, int, int]) -> None:
        at = bisect.bisect_left(self.starts, span[0])
        self.starts.insert(at, span[0])
        self.ends.insert(at, span[2])


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    start, kind, end = span
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    before, after = text[max(0, start - 30) : start], text[end : end + 12]
    iban = 0.0
    if kind == 4:
        flat = s.replace(" ", "")
        turned = flat[4:] + flat[:4]
        iban = float(turned.isalnum() and turned.isascii() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1)
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(s), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1],
        s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count("(") + s.count("["), sum(c.isalpha() for c in s),
        float(s[0] == "+"), float(s[:2] == "00"), float(s[0] == "0"), float(s[0] == "("), float(s.count("(") == s.count(")")),
        float(bool(digits) and luhn(digits)), float(len(groups) == 4 and all(int(g) <= 255 for g in re.findall(r"[0-9]+", s)) if max(groups) <= 3 else 0), iban,
        len(set(digits)), float("@" in s), float(bool(re.search(r"[\[({]\s?(?:at|dot)|\[\.\]|\(\.\)", s, re.IGNORECASE))), float(len(re.findall(r"\bdot\b", s, re.IGNORECASE))),
        *(float(bool(w.search(before))) for w in _WORDS.values()),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€£#=\"'/"), float(":" in before[-3:]), float(after[:1] in "%\"'/€$"),
        # formats: American numbers, pairs of digits, equal groups, a year or day first, kinds of separators
        float(groups == [3, 3, 4]), float(len(groups) >= 4 and set(groups[1:]) == {2}), float(len(groups) > 2 and len(set(groups)) == 1), float(groups[0] == 4 and s.lstrip("(")[:2] in ("19", "20")), float(groups[:2] == [2, 2] and len(groups) == 3), len(set(re.findall(r"[^0-9A-Za-z]", s))),
    ]


#: Places of features: the checks of a number, an address and an account, marks of a spoken address, and for each kind whether
#: a word before it announces it.
_LUHN, _OCTETS, _CHECKED, _MARKED = 23, 24, 25, 28
_ANNOUNCED = {0: 31, 1: 33, 2: 32, 3: 30, 4: 34}


@dataclass
class Model:
    trees: boosting.Trees
    thresholds: list[float]


def _checked(digits: str) -> str:
    return digits + next(str(d) for d in range(10) if luhn(digits + str(d)))


def _example(rng: random.Random) -> tuple[str, int, int]:
    """(text, kind, label) of a generated candidate with a word before it."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9)))
    kind, good = rng.randrange(5), rng.random() < 0.5
    cue = lambda p, words: rng.choice(words) + rng.choice((" ", ": ")) if rng.random() < p else ""
    off = lambda: cue(0.6, ("version", "order no", "page", "date", "total", "price $", "#"))
    if kind == 0:
        if good:
            at, dot = rng.choice(((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" @ ", "."), ("(at)", ".")))
            return cue(0.5, ("mail", "contact", "write to")) + w() + rng.choice((".", "_", "", dot)) + w() + at + w() + dot + rng.choice(("com", "org", "net", "de", "fr", "es")), 0, 1
        return w() + " at " + w() + rng.choice((". ", ". ", " . ")) + w().title(), 0, 0
    if kind == 1:
        part = lambda: str(rng.randint(0, 255))
        if good:
            return cue(0.5, ("ip", "host", "server")) + rng.choice(("[.]", "(.)", ".")).join(part() for _ in range(4)), 1, 1
        return off() + rng.choice((". ", ".", " . ")).join(rng.choice((str(rng.randint(256, 999)), part())) for _ in range(3)) + "." + str(rng.randint(256, 999)), 1, 0
    if kind == 2:
        digits = _checked(rng.choice("3456") + d(14))
        if not good:
            digits = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        if not good and rng.random() < 0.4:  # part of a longer token, whatever its check digit
            return rng.choice(("token = ", "id ", "")) + rng.choice(('"', "")) + "".join(rng.choice("0123456789abcdef") for _ in range(9)) + "e" + _checked(d(rng.randint(11, 15))) + "ab3", 2, 0
        sep = rng.choice(("", " ", "-", ".", "/", "  ", "_"))
        return (cue(0.5, ("card", "visa", "pay with")) if good else off()) + sep.join(digits[i : i + 4] for i in range(0, 16, 4)), 2, int(good)
    if kind == 3:
        if good:
            abroad = "00" + rng.choice(("1", "49", "33", "34", "44"))
            sep = rng.choice("-. ")
            forms = (
                lambda: f"{abroad} {d(3)} {d(3)} {d(4)}", lambda: f"{abroad} {d(rng.randint(2, 4))} {d(rng.randint(5, 8))}", lambda: f"{abroad}{d(rng.randint(8, 10))}",
                lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: sep.join((d(3), d(3), d(4))), lambda: f"0{d(2)}/{d(3)} {d(4)}", lambda: f"0{d(rng.randint(2, 4))}{rng.choice(' /-')}{d(rng.randint(5, 8))}",
                lambda: "0" + d(1) + sep + sep.join(d(2) for _ in range(4)), lambda: "0" + d(9),
            )
            text = rng.choice(forms)()
            return cue(0.5, ("tel", "phone", "call", "mobile", "Tel.", "fax", "appelez le", "llama al")) + text, 3, 1
        if rng.random() < 0.25:  # part of a longer token
            h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
            return rng.choice(("token = ", "id ", "")) + rng.choice(('"', "")) + h(12) + "e" + d(rng.randint(7, 12)) + "b" + h(8), 3, 0
        text = rng.choice((lambda: d(4) + "-" + d(2) + "-" + d(2), lambda: d(16), lambda: d(rng.randint(11, 16)), lambda: d(2) + "." + d(2) + "." + d(4), lambda: d(rng.randint(7, 20)), lambda: d(3) + " " + d(3) + " " + d(3), lambda: d(2) + "/" + d(2) + "/" + d(4), lambda: " ".join(d(1) for _ in range(9)),
            lambda: f"97{rng.choice('89')}-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{rng.randint(1, 99)}.{d(3)}.{d(3)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", lambda: f"{d(2)}:{d(2)} {d(2)}/{d(2)}/{d(2)}",
            lambda: f"{rng.randint(1, 9)}{d(3)} {rng.randint(1, 9)}{d(3)}", lambda: f"{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(2)}-{d(4)}-{d(3)}", lambda: "-".join(d(2) for _ in range(rng.randint(4, 7)))))()

        return off() + text, 3, 0
    body = d(18)
    code = rng.choice(("DE", "FR", "ES", "NL"))
    check = 98 - int("".join(str(int(c, 36)) for c in body + code + "00")) % 97
    flat = f"{code}{check if good else (check + rng.randint(1, 96)) % 97 + 2:02d}{body}"
    return (cue(0.5, ("IBAN", "account", "Konto")) if good else off()) + rng.choice(("", " ")).join(flat[i : i + 4] for i in range(0, len(flat), 4)), 4, int(good)


def drawn(contexts: list[str], seed: int) -> list[str]:
    """At most SENTENCES different sentences of the whole texts, by a seeded choice; one if there is none."""
    found = sorted({s.strip() for t in contexts for s in re.split(r"[.\n]", t) if s.strip()})
    return (found if len(found) <= SENTENCES else random.Random(seed).sample(found, SENTENCES)) or ["and then"]


def train(contexts: list[str], seed: int = 11) -> Model:
    """Fits trees and thresholds; contexts are real texts, into whose sentences the examples are set. It may be empty."""
    rng, x, y, kinds = random.Random(seed), [], [], []
    sentences = drawn(contexts, seed)
    for _ in range(EXAMPLES):
        body, kind, label = _example(rng)
        lead, tail = rng.choice(sentences)[-40:] + " ", rng.choice((" ", ", ", ". ")) + rng.choice(sentences)[:40]
        text = lead + body + tail
        for span in candidates(text):
            if span[1] == kind and span[0] >= len(lead) - 1 and span[2] <= len(lead) + len(body):
                x.append(features(text, span))
                y.append(label)
                kinds.append(kind)
    generated = len(y)
    for text in contexts:
        base = Taken(base_spans(text))
        for span in candidates(text):
            if not base.meets(span):
                f = features(text, span)
                # One that passes its check, or is announced, may be what it looks like; of the rest nobody says so.
                sure = f[_OCTETS] if span[1] == 1 else f[_LUHN] if span[1] == 2 else f[_CHECKED] if span[1] == 4 else f[_MARKED]
                if not sure and not f[_ANNOUNCED[span[1]]]:
                    x.append(f)
                    y.append(0)
                    kinds.append(span[1])
    x, y, kinds = np.array(x, float), np.array(y, float), np.array(kinds)
    aside = np.arange(len(y)) % 4 == 0
    weight = np.where(np.arange(len(y)) < generated, LOOK_ALIKES, 1.0)  # of a look-alike; real ones are there as often as they occur
    model = Model(boosting.fit(x[~aside], y[~aside], TREES, DEPTH), [])
    p = model.trees.probability(x[aside])
    for k in range(len(KINDS)):
        own, truth, heavy = (v[kinds[aside] == k] for v in (p, y[aside], weight[aside]))
        order = np.lexsort((truth, -own))  # of equal scores look-alikes first
        right = np.cumsum(truth[order])
        precise = (right >= PRECISION * (right + np.cumsum(((1 - truth) * heavy)[order]))) & (truth[order] == 1)
        model.thresholds.append(float(own[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.1)
    return model


def fit_on(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Trains with at most `rows` documents as contexts, those with the smallest hash of doc_id."""
    return train(sorted(r.text for r in bounded_sample(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id", rows).collect()))


def find(batch: list[str], model: Model) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, both sorted, as (start, kind, end)."""
    base, proposed, x = [base_spans(t) for t in batch], [], []
    taken = [Taken(b) for b in base]
    for i, text in enumerate(batch):
        for span in candidates(text):
            if not taken[i].meets(span):
                proposed.append((i, span))
                x.append(features(text, span))
    every = [list(b) for b in base]
    if x:
        p = model.trees.probability(np.array(x, float))
        for k in np.lexsort((np.arange(len(p)), -p)):
            i, span = proposed[k]
            if p[k] >= model.thresholds[span[1]] and not taken[i].meets(span):
                taken[i].add(span)
                every[i].append(span)
    return [(b, sorted(e)) for b, e in zip(base, every, strict=True)]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans count as one, named by the first."""
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """Spans in each row's whole text: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_spans, spans.

    Offsets are in code points, the end excluded. A null text counts as empty and has no spans. Repeated rows are
    answered one by one; further columns of docs are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: TREES trees of DEPTH levels

    def run(batches):
        for batch in batches:
            found = find(texts(batch.column(1)), shared.value)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([listed(b) for b, _ in found], pa.string()), pa.array([listed(e) for _, e in found], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = detect(docs, fit_on(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def redact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row, personal data in its text replaced, n_chars set anew; columns of documents.

    Contexts for the training come from documents of sf_dir. A null text stays null.
    """
    return redact_with(docs, fit_on(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def redact_with(docs: DataFrame, model: Model) -> DataFrame:
    bounded_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            raw = batch.column(at).to_pylist()
            found = find([t or "" for t in raw], shared.value)
            new = pa.array([None if t is None else redacted(t, e) for t, (_, e) in zip(raw, found, strict=True)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out
