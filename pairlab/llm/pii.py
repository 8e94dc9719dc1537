"""Personal data: base patterns, joined by a semi-Markov conditional random field over candidate regions.

The base spans are matches of fixed patterns. The field scores whole segments of up to MAX_TOKENS tokens
with a type or none: shape, digits, cue words before it, Luhn sum, part counts. A bounded dynamic programme
chooses boundaries and types together; it runs where digits, @ or written-out address words stand, and
everywhere else no segment can be an entity. What it finds outside base spans is added.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import chunks

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, with runs taken whole from their start, so that long ones cost their length.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
RUN_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL.pattern)
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens of an entity at most; so many less one can stand on either side of a cue.
MAX_TOKENS = 7
AROUND = MAX_TOKENS - 1
#: The longest address there can be by its standard: a longer token is part of no entity and ends a region.
LONGEST = 254
#: Words of the corpus that generated cases stand among.
CASE_WORDS = 5000
LABELS = ("none", *KINDS)
TOKENS = re.compile(r"[^\x00-\x20]+")
#: What may start an entity that no base pattern takes: written-out addresses, grouped digits.
CUES = (re.compile(r"[(\[{][aA][tT][)\]}]"), re.compile(r"(?i) at \S+ dot "), re.compile(r"[0-9][0-9().,\x20/-]{5,}[0-9]"))
EDGE = "\"'`.,;:!?<>[]{}|*#%&$"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all base matches, by start, then kind; failing matches are dropped, not retried."""
    out = []
    at = 0
    while "@" in text and (m := at and EMAIL.match(text, at) or RUN_EMAIL.search(text, at)):
        at = m.end()
        out.append((m.start(), at, 0))
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0]) if m.end() - m.start() >= 14 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted((a, b, k) for a, b, k in out)


def segment_features(tokens: list[str], i: int, j: int) -> list[str]:
    """Names of the features of the segment tokens[i:j]."""
    raw = " ".join(tokens[i:j])
    text = raw.strip(EDGE)
    digits = re.sub(r"[^0-9]", "", text)
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "0", text.lower()))
    f = [f"n={j - i}", f"digits={min(20, len(digits))}", f"shape={shape[:24]}", f"first={text[:1] if not text[:1].isalnum() else 'alnum'}"]
    f.append(f"only={'digits' if re.fullmatch(r'[0-9 ().+-]+', text) else 'mixed' if digits else 'letters'}")
    if digits and len(digits) <= 20:
        groups = re.findall("[0-9]+", text)
        f += [f"lead={'00' if digits[:2] == '00' else '0' if digits[0] == '0' else 'other'}", f"groups={','.join(str(len(g)) for g in groups)}"]
    if 13 <= len(digits) <= 19:
        f.append(f"luhn={luhn(digits)}")
    low = raw.lower()
    f.append(f"at={'@' in low or '(at)' in low or '[at]' in low or '{at}' in low or ' at ' in low}{'.' in text or ' dot ' in low or '(dot)' in low or '[dot]' in low}")
    if j - i > 2 and not digits:
        joints = " ".join(w if w in ("at", "dot") else "x" for w in low.split(" "))
        f += [f"joints={joints}", f"joints={joints},{text.lower().rsplit(' ', 1)[-1] in ENDINGS}"]
    if j - i == 1 and digits and re.fullmatch(r"[0-9.]+", text):
        parts = text.split(".")
        f.append(f"parts={len(parts)},{all(p and int(p[:6]) <= 255 for p in parts)}")
    f.append(f"before={re.sub('[^a-z]', '', tokens[i - 1].lower())[:8] if i else '^'}")
    if j < len(tokens):
        f.append(f"after={'digit' if tokens[j][:1].isdigit() or tokens[j][:1] in '+(' else 'other'}")
    if i:
        f.append(f"behind={'digit' if tokens[i - 1][-1:].isdigit() else 'other'}")
    return f


@dataclass
class SemiCrf:
    weights: list[dict[str, float]]  # of each label

    def score(self, names: list[str], label: int) -> float:
        get = self.weights[label].get
        return sum(get(x, 0.0) for x in names)

    def decode(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(first token, end token, label) of the best segmentation's entities; `none` segments have one token."""
        n = len(tokens)
        best, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - MAX_TOKENS), j):
                names = segment_features(tokens, i, j)
                for label in range(0 if j - i == 1 else 1, len(LABELS)):
                    s = best[i] + self.score(names, label)
                    if s > best[j]:
                        best[j], back[j] = s, (i, label)
        out, j = [], n
        while j:
            i, label = back[j]
            if label:
                out.append((i, j, label))
            j = i
        return out[::-1]


def fit(cases: list[tuple[list[str], list[tuple[int, int, int]]]], steps: int = 24, rate: float = 0.3, decay: float = 1e-3) -> SemiCrf:
    """Maximum likelihood over all segmentations (semi-Markov forward-backward), AdaGrad over the cases."""
    weights: list[dict[str, float]] = [{} for _ in LABELS]
    squares: list[dict[str, float]] = [{} for _ in LABELS]
    prepared = []
    for tokens, gold in cases:
        n = len(tokens)
        names = {(i, j): segment_features(tokens, i, j) for j in range(1, n + 1) for i in range(max(0, j - MAX_TOKENS), j)}
        inside = {k for a, b, _ in gold for k in range(a, b)}
        truth = {(a, b, y) for a, b, y in gold} | {(k, k + 1, 0) for k in range(n) if k not in inside}
        spans = [(i, j, y) for i, j in names for y in range(0 if j - i == 1 else 1, len(LABELS))]
        ending, starting = ([[k for k, span in enumerate(spans) if span[side] == at] for at in range(n + 1)] for side in (1, 0))
        prepared.append((n, names, spans, ending, starting, [span in truth for span in spans]))

    def total(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    rng = random.Random(5)
    for _ in range(steps):
        rng.shuffle(prepared)
        for n, names, spans, ending, starting, true in prepared:
            s = [sum(weights[y].get(x, 0.0) for x in names[i, j]) for i, j, y in spans]
            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                forward[j] = total([forward[spans[k][0]] + s[k] for k in ending[j]])
            for i in range(n - 1, -1, -1):
                backward[i] = total([backward[spans[k][1]] + s[k] for k in starting[i]])
            z = forward[n]
            for k, (i, j, y) in enumerate(spans):
                g = math.exp(min(0.0, forward[i] + s[k] + backward[j] - z)) - true[k]
                if abs(g) < 1e-3:
                    continue
                for x in names[i, j]:
                    w = weights[y].get(x, 0.0)
                    d = g + decay * w
                    q = squares[y][x] = squares[y].get(x, 1e-2) + d * d
                    weights[y][x] = w - rate * d / q**0.5
    return SemiCrf(weights)


#: Parts of the generated cases: last and next-to-last parts of host names, words ahead of phone numbers and of other numbers.
TOPS, SECONDS = ("com", "org", "net", "de", "fr", "es", "edu", "io", "info", "eu"), ("co uk", "ac uk", "com br", "edu au", "co jp")
ENDINGS = {*TOPS, *(x.split(" ")[1] for x in SECONDS)}
CALLS, NUMBERED = ("call", "phone", "tel", "fax", "mobile", "ring", "dial"), ("order", "invoice", "ref", "isbn", "ticket", "item", "part", "case", "number", "serial", "account", "page")


def labelled_cases(words: list[str], n: int = 600, seed: int = 42) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Short token runs with known entities among words of the corpus: base forms, written-out forms of one to three
    parts in either case, national and foreign numbers, and numbers that are none."""
    rng = random.Random(seed)
    words = words or ["the", "of", "and", "with", "for"]

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def grouped(lead: str, *sizes: int, by: str = " ") -> list[str]:
        return by.join([lead + digits(sizes[0]), *map(digits, sizes[1:])]).split(" ")

    def card() -> str:
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def address() -> list[str]:
        name, host = rng.choice(words).lower(), rng.choice(words).lower()
        name = rng.choice([name, name, f"{name}.{rng.choice(words).lower()}", f"{name}_{host}", name + digits(2)])
        hosts = [*rng.choice([[host], [host], [f"{host}-{rng.choice(words).lower()}"], ["mail", host]]), rng.choice(TOPS)]
        if len(hosts) == 2 and rng.random() < 0.3:
            hosts = [hosts[0], *rng.choice(SECONDS).split()]
        if rng.random() < 0.2:
            return [f"{name}@{'.'.join(hosts)}"]
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), ("at", "dot"), ("at", "dot"), ("(at)", "."), ("[at]", ".")])
        at, dot = (at.upper(), dot.upper()) if rng.random() < 0.3 else (at, dot)
        if dot == ".":
            return rng.choice([[f"{name}{at}{'.'.join(hosts)}"], [name, at, ".".join(hosts)]])
        return [name, at, *f" {dot} ".join(hosts).split(" ")]

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        forms = [["+1", f"({a})", f"{b}-{c}"], [f"+{digits(2)}", a, b, c], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"]]
        national = [grouped("0", 2, 4, 4), grouped("0", 3, 3, 4), grouped("0", 1, 2, 2, 2, 2), grouped("0", 3, 7), grouped("0", 2, 7, by="/"), grouped("0", 3, 6, by="-"), [f"(0{digits(2)})", digits(4), digits(4)]]
        abroad = [grouped("00", 2, 2, 3, 2, 2), grouped("00", 2, 3, 3, 3), grouped("00", 2, 2, 4, 4), grouped("00", 1, 3, 3, 4)]
        return rng.choice(rng.choice([forms, national, abroad]))

    def entity() -> tuple[list[str], int]:
        kind = rng.choice([1, 1, 2, 3, 4, 4])
        if kind == 1:
            return address(), 1
        if kind == 2:
            return [".".join(str(rng.randint(0, 255)) for _ in range(4))], 2
        if kind == 3:
            c = card()
            return rng.choice([[c], [c[:4], c[4:8], c[8:12], c[12:]], ["-".join([c[:4], c[4:8], c[8:12], c[12:]])]]), 3
        return phone(), 4

    def decoy() -> list[str]:
        d = digits(16)
        if luhn(d):
            d = d[:-1] + str((int(d[-1]) + 1) % 10)
        year = f"20{digits(2)}"
        plain = [[d], [d[:4], d[4:8], d[8:12], d[12:]], [digits(rng.randint(1, 8))], [f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}"], [f"{digits(1)}.{digits(1)}.{digits(2)}"], [f"{digits(2)}.{digits(3)},{digits(2)}"], [digits(20)], ["at", rng.choice(words), rng.choice(words)], [f"{rng.randint(256, 999)}.{digits(2)}.{digits(1)}.{digits(2)}"], [f"{digits(2)}:{digits(2)}:{digits(2)}"], [digits(10)], [f"{digits(3)}-{digits(4)}"]]
        others = [[year, f"20{digits(2)}", f"20{digits(2)}"], [f"{rng.randint(1, 28)}", f"{rng.randint(1, 12)}", year], [f"{rng.randint(1, 9)}", digits(3), digits(3)], ["at", rng.choice(words), "dot", rng.choice(words)], [f"{year}-{digits(4)}-{digits(4)}"], [f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"], [f"0.{digits(7)}"]]
        numbers = [[f"{digits(3)}-{digits(4)}-{digits(4)}"], [f"{digits(4)}-{digits(4)}"], grouped("", 3, 4, 4), grouped("", 4, 4), [digits(12)], [f"{digits(2)}-{digits(5)}-{digits(3)}"]]
        pick = rng.random()
        return rng.choice(plain) if pick < 0.5 else rng.choice(others) if pick < 0.7 else [rng.choice(NUMBERED), *rng.choice(numbers)]

    out = []
    for _ in range(n):
        tokens = [rng.choice(words) for _ in range(rng.randint(1, 3))]
        gold = []
        if rng.random() < 0.6:
            e, y = entity()
            tokens += [rng.choice(CALLS) + rng.choice(["", ":"])] if y == 4 and rng.random() < 0.3 else []
            gold.append((len(tokens), len(tokens) + len(e), y))
            e[-1] += rng.choice(["", "", ".", ","])
            tokens += e
        else:
            tokens += decoy()
        tokens += [rng.choice(words) for _ in range(rng.randint(1, 3))]
        out.append((tokens, gold))
    return out


def train(docs: DataFrame, words: int = CASE_WORDS) -> SemiCrf:
    """Trains on generated cases among at most `words` different words of the corpus, chosen by a hash."""
    every = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))).alias("w")).distinct()
    got = every.orderBy(F.xxhash64("w", F.lit("pii")), "w").limit(words).collect()
    return fit(labelled_cases(sorted(r.w for r in got)))


def without(text: str, base: list[tuple[int, int, int]]) -> str:
    """text with tabs in place of the base spans: no cue and no token goes over them."""
    parts, at = [], 0
    for a, b, _ in sorted(base):
        if b > at:
            parts += [text[at : max(at, a)], "\t" * (b - max(at, a))]
            at = b
    return "".join([*parts, text[at:]])


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiCrf) -> list[tuple[int, int, int]]:
    """Entities of the field that touch no base span; regions hold a cue beside the base spans."""
    out, done, reach = [], 0, AROUND * (LONGEST + 1)
    text = without(text, base)
    taken = sorted(base)
    ends = list(accumulate((b for _, b, _ in taken), max))  # the furthest end of a base span that starts no later
    for m in sorted((m for cue in CUES for m in cue.finditer(text)), key=lambda m: m.start()):
        if m.start() < done:
            continue
        low = max(done, m.start() - reach)
        high = min(len(text), m.end() + reach)
        found = [(low + t.start(), low + t.end()) for t in TOKENS.finditer(text[low:high])]
        if low and found and not text[low - 1].isspace() and found[0][0] == low:
            found = found[1:]
        if high < len(text) and found and not text[high].isspace() and found[-1][1] == high:
            found = found[:-1]
        inner = [k for k, (a, b) in enumerate(found) if a < m.end() and m.start() < b]
        if not inner:
            continue
        found = found[max(0, inner[0] - AROUND) : inner[-1] + 1 + AROUND]
        long = [k for k, (a, b) in enumerate(found) if b - a > LONGEST]
        if any(a < m.end() and m.start() < b for a, b in (found[k] for k in long)):
            done = max(done, m.end())
            continue
        first = max((k + 1 for k in long if found[k][1] <= m.start()), default=0)
        found = found[first : min((k for k in long if found[k][0] >= m.end()), default=len(found))]
        tokens = [text[a:b] for a, b in found]
        for i, j, label in model.decode(tokens):
            a, b = found[i][0], found[j - 1][1]
            while a < b and (text[a] in EDGE or text[a].isspace()):
                a += 1
            while b > a and (text[b - 1] in EDGE or text[b - 1].isspace()):
                b -= 1
            before = bisect_left(taken, (b,))  # base spans that start before the entity's end
            if a < b and a >= done and not (before and ends[before - 1] > a):
                out.append((a, b, label - 1))
                done = b
        done = max(done, m.end())
    return out


def find(docs: DataFrame, model: SemiCrf) -> DataFrame:
    """docs plus pii: array of (kind, start, end, base); code points, end exclusive, by start, then kind.

    A null text counts as empty. A column named pii is replaced, others pass through; repeated rows stay; an
    empty table gives no rows. A text of any length is searched whole, by one task, in time that grows with it.
    """
    names = [c for c in docs.columns if c.lower() != "pii"]
    source, at = docs.select(*[F.col(f"`{c}`") for c in names]), names.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for batch in chunks(batches):
            rows = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text or "")
                both = [(a, k, b, True) for a, b, k in base] + [(a, k, b, False) for a, b, k in added_spans(text or "", base, crf)]
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in sorted(both)])
            yield pa.record_batch([*batch.columns, pa.array(rows, arrow)], names=[*names, "pii"])

    return source.mapInArrow(run, source.withColumn("pii", F.lit(None).cast(kind)).schema)


def digest(docs: DataFrame, model: SemiCrf) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and hash of base spans, and all spans."""
    found = find(docs.select("doc_id", "text"), model)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["base"])
    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
