"""Personal data by a semi-Markov conditional random field over base patterns.

Base spans come from four fixed patterns (email, ip, card, phone) and always stay. The
model adds spans that the patterns miss. It looks only at *zones*: stretches of tokens
around a digit, an ``@`` or a spelled-out one. In a zone every run of up to ``MAX_TOKENS``
tokens that could be an entity is a candidate segment; features look at the whole
segment (digits, group sizes, shape, checksum, octets, what stands beside it), and a
dynamic programme over segment ends picks boundaries and types of the zone together.
Zones all of whose cues lie in base spans are left out: each candidate there would
overlap a base span and be dropped.

The weights maximise the exact conditional likelihood (forward and backward over the
same segments) on a bounded sample of texts (``SAMPLE`` rows, of each the first
``SAMPLE_ZONES`` zones): their base spans, and the
same spans rewritten in ways that the patterns don't know (no plus sign, dots or
dashes between the groups, "at" and "dot" spelled out) are the labels. Sentences of
ordinary numbers (orders, books, moments, versions) without any span are learned from, too.

Defined cases: null counts as the empty text; without spans ``base_sha256`` is the
digest of the empty string and ``spans`` is empty; repeated rows are searched one by one;
texts of any length are searched whole; an empty table gives an empty result; with no
sample to learn from only base spans are found.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, pick_sample, read

KINDS = ("email", "ip", "card", "phone")
#: Texts with a digit or @ that the model is learned from, and zones of each of them, at most.
SAMPLE, SAMPLE_ZONES = 500, 50
EPOCHS = 4
#: Tokens of an entity, at most.
MAX_TOKENS = 14
#: Characters of a zone that are learned from, at most: a longer zone is learned from its beginning, and searched whole.
LEARN_CHARS = 600
#: How much likelier (in nats) the added spans of a zone must be than none.
MARGIN = 2.0

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CUE = re.compile(r"[0-9@]|[\[(] ?at ?[\])]")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
AT = re.compile(r"@|[\[(] ?at ?[\])]")
#: What a number that isn't base may look like: digits in groups, set apart by few kinds of marks.
NUMBER = re.compile(r"[+(]?[0-9](?:[ ().-]{0,3}[0-9])*")
#: Dates, alone or inside of a run of numbers.
DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2(?:19|20)[0-9]{2})(?![0-9])")
#: Characters of a segment whose features are kept for its next time.
LOCAL_CHARS = 120
#: Digits of cards and phones, as the base patterns have them.
LEAST_DIGITS, MOST_DIGITS = 10, 19


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of the email pattern; from each @ the local part is read backwards, so long runs cost no more than their length."""
    over = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > over and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            over = m.end()
        # what was read backwards without success is not read again: the next @ stops here
        at = text.find("@", max(at + 1, over))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out = [(a, b, 0) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def zones(text: str, covered: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of text around cues; without those whose cues all lie in covered spans."""
    out: list[list] = []
    spans, k = sorted(covered), 0
    reach = 0
    for m in CUE.finditer(text):
        while k < len(spans) and spans[k][0] <= m.start():
            reach = max(reach, spans[k][1])
            k += 1
        free = m.start() >= reach
        if out and m.start() - out[-1][1] <= 16:
            out[-1][1], out[-1][2] = m.end(), out[-1][2] or free
        else:
            out.append([m.start(), m.end(), free])
    found = []
    for begin, end, free in out:
        if free:
            a, b = max(0, begin - 40), min(len(text), end + 40)
            # whole tokens only
            while a > max(0, begin - 80) and text[a - 1 : a].isalnum():
                a -= 1
            while b < min(len(text), end + 80) and text[b : b + 1].isalnum():
                b += 1
            found.append((a, b))
    return found


def side(c: str) -> str:
    return "end" if not c else "alpha" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c


def number_like(text: str, a: int, b: int, digits: str, groups: list[str]) -> bool:
    """Whether a segment without @ can be a card, a phone or an address: dates, times, versions, prices and parts of longer numbers can't."""
    s = text[a:b]
    if text[a - 1 : a].isalnum() or text[b : b + 1].isalnum() or text[a - 1 : a] in tuple(":/.,$-_#") or text[b : b + 1] in tuple(":/%_"):
        return False
    if text[b : b + 1] in tuple(".,-") and text[b + 1 : b + 2].isdigit():
        return False
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and re.fullmatch(r"[0-9]+(?: ?[.] ?[0-9]+){3}", s):
        return True
    return LEAST_DIGITS <= len(digits) <= MOST_DIGITS and bool(NUMBER.fullmatch(s)) and not DATE.search(s)


def span_features(text: str, a: int, b: int) -> list[str] | None:
    """Features of a whole segment; None if it can be no entity."""
    s = text[a:b]
    digits = re.sub(r"[^0-9]", "", s)
    at = AT.search(s)
    if s[0].isspace() or s[-1].isspace() or "\n" in s:
        return None
    groups = re.findall(r"[0-9]+", s)
    if not at and not number_like(text, a, b, digits, groups):
        return None
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", s))
    out = ["bias", f"digits={min(len(digits), 21)}", f"shape={shape if len(shape) <= 16 else 'long'}", f"before={side(text[a - 1 : a])}", f"after={side(text[b : b + 1])}", f"first={side(s[0])}", f"last={side(s[-1])}"]
    if at:
        out.append("at")
        out.append(f"ats={min(2, len(AT.findall(s)))}")
        sides = s[: at.start()].strip(), s[at.end() :].strip()
        out += [f"{name}={'spaced' if any(c.isspace() for c in x) else 'empty' if not x else 'whole'}" for name, x in zip(("local", "domain"), sides, strict=True)]
        out.append(f"dotted={bool(re.search(r'(?:[.]| dot )[A-Za-z]{2,}$', s))}")
    else:
        out.append("groups=" + "-".join(str(min(len(g), 9)) for g in groups[:6]))
        out.append(f"letters={any(c.isalpha() for c in s)}")
        out.append(f"octets={len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
        out.append(f"checksum={14 <= len(digits) <= 19 and luhn(digits)}")
        out.append("marks=" + "".join(sorted(set(re.findall(r"[^\w\s]", s))))[:6])
    return out


@lru_cache(20_000)
def features_in(window: str, a: int, b: int) -> tuple[str, ...] | None:
    """The same for a segment with the characters beside it, which are all that its features see; logs repeat themselves."""
    found = span_features(window, a, b)
    return None if found is None else tuple(found)


def tokens(text: str, a: int, b: int) -> tuple[list[int], list[int], list[int]]:
    """Where the tokens of a zone begin and end, digits before each, and for each token the next one (or itself) that spells out an @."""
    cuts = [a, *(a + m.end() for m in TOKEN.finditer(text[a:b]))]
    n = len(cuts) - 1
    digits, at = [0] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        token = text[cuts[i] : cuts[i + 1]]
        at[i] = i if token == "@" or token == "at" else at[i + 1]
    for i in range(n):
        token = text[cuts[i] : cuts[i + 1]]
        digits[i + 1] = digits[i] + (len(token) if token[0].isdigit() else 0)
    return cuts, digits, at


def candidates(text: str, cuts: list[int], digits: list[int], at: list[int], i: int) -> Iterator[tuple[int, list[str]]]:
    """(end, features) of the segments from token ``i`` on. Most are left out by counts alone: what has no @ needs the digits of an entity."""
    n = len(cuts) - 1
    first = text[cuts[i]]
    if first.isspace():
        return
    number = first in "+(" or first.isdigit()
    # an entity has one @ at most
    last = n if at[i] >= n else at[at[i] + 1]
    for j in range(i + 1, min(n, i + MAX_TOKENS, last) + 1):
        many = digits[j] - digits[i]
        if at[i] >= j and (not number or many > MOST_DIGITS or many < (LEAST_DIGITS if j - i < 7 else 4)):
            if number and many > MOST_DIGITS and at[i] >= i + MAX_TOKENS:
                return
            continue
        begin = max(0, cuts[i] - 1)
        look = features_in if cuts[j] - begin <= LOCAL_CHARS else features_in.__wrapped__
        f = look(text[begin : cuts[j] + 2], cuts[i] - begin, cuts[j] - begin)
        if f is not None:
            yield j, f


class Lattice:
    """Candidate segments of a zone: (first token, last token + 1, features)."""

    def __init__(self, text: str, a: int, b: int):
        self.cuts, digits, at = tokens(text, a, b)
        self.n = len(self.cuts) - 1
        self.segments = [(i, j, f) for i in range(self.n) for j, f in candidates(text, self.cuts, digits, at, i)]

    def weigh(self, index: dict[str, int], w: np.ndarray) -> np.ndarray:
        """Score of each segment for each kind; w has a row for each feature."""
        out = np.zeros((len(self.segments), len(KINDS)))
        for k, (_, _, f) in enumerate(self.segments):
            rows = [index[x] for x in f if x in index]
            if rows:
                out[k] = w[rows].sum(axis=0)
        return out

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each segment and kind (forward and backward)."""
        fore, rear = [0.0] + [-math.inf] * self.n, [-math.inf] * self.n + [0.0]
        total = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        ends: list[list[int]] = [[] for _ in range(self.n + 1)]
        starts: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (i, j, _) in enumerate(self.segments):
            ends[j].append(k)
            starts[i].append(k)
        for j in range(1, self.n + 1):
            fore[j] = np.logaddexp.reduce([fore[j - 1], *(fore[self.segments[k][0]] + total[k] for k in ends[j])])
        for i in range(self.n - 1, -1, -1):
            rear[i] = np.logaddexp.reduce([rear[i + 1], *(rear[self.segments[k][1]] + total[k] for k in starts[i])])
        around = np.array([fore[i] + rear[j] for i, j, _ in self.segments]) - fore[self.n]
        return np.exp(np.minimum(0, scores + around[:, None]))


def decode(text: str, a: int, b: int, index: dict[str, int], w: np.ndarray) -> tuple[float, list[tuple[int, int, int]]]:
    """Highest-scoring segmentation of a zone; tokens outside score 0.

    Segments are scored as the programme comes to their first token and are then
    forgotten, so memory grows with the tokens of a zone, not with its segments.
    """
    cuts, digits, at = tokens(text, a, b)
    n = len(cuts) - 1
    value, back, scored = [-math.inf] * (n + 1), [None] * (n + 1), {}
    value[0] = 0.0
    for i in range(n + 1):
        if i and value[i - 1] >= value[i]:
            value[i], back[i] = value[i - 1], None
        for j, f in candidates(text, cuts, digits, at, i) if i < n else ():
            if (known := scored.get(f)) is None:
                scores = w[[index[x] for x in f if x in index]].sum(axis=0)
                known = scored[f] = (float(scores.max()), int(scores.argmax()))
            score, kind = known
            if (v := value[i] + score) > value[j]:
                value[j], back[j] = v, (i, kind)
    found, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            found.append((cuts[i], cuts[j], kind))
            j = i
    return value[n], found[::-1]


def rewritten(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans written in other ways, and where they are then."""
    out, at, found, size = [], 0, [], 0
    for a, b, kind in spans:
        if a < at:
            continue
        s = text[a:b]
        if kind == 0:
            s = s.replace("@", rng.choice([" [at] ", "[at]", " (at) ", "@"]))
        elif kind == 3:
            d = re.sub(r"[^0-9]", "", s)[-10:]
            s = rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", s])
        elif kind == 2:
            d = re.sub(r"[^0-9]", "", s)
            s = rng.choice([".".join(d[i : i + 4] for i in range(0, len(d), 4)), s])
        out += [text[at:a], s]
        size += a - at
        found.append((size, size + len(s), kind))
        size += len(s)
        at = b
    return "".join([*out, text[at:]]), found


def ordinary(rng: random.Random) -> str:
    """A sentence of numbers that are nobody's: orders, books, moments, versions, measures."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return " ".join(
        rng.sample(
            [
                f"order {d(10)} was shipped",
                f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)} in stock",
                f"ticket #{d(11)} is closed",
                f"at {rng.randint(2001, 2029)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)} sharp",
                f"build 10.0.{d(5)}.{d(4)} fails",
                f"it costs {d(3)},{d(3)}.{d(2)} euros",
                f"since {d(10)} seconds and {d(13)} milliseconds",
                f"rows {d(5)} {d(5)} {d(5)} of the table",
                f"from {d(4)} to {d(4)} and {d(4)} more",
            ],
            4,
        )
    )


def train(docs: DataFrame, sample: int = SAMPLE):
    """(feature index, weights) learned from at most ``sample`` texts that hold a digit or @."""
    some = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9]{3}|@")).withColumn("k", F.lit(1))
    rng = random.Random(7)
    zones_: list[tuple[Lattice, dict]] = []
    for r in pick_sample(some, "k", sample):
        spans = base_spans(r.text)
        for text, gold in ((r.text, spans), rewritten(r.text, spans, rng), (ordinary(rng), [])):
            gold_at = {(a, b): k for a, b, k in gold}
            for a, b in zones(text, [])[:SAMPLE_ZONES]:
                lattice = Lattice(text, a, min(b, a + LEARN_CHARS))
                if lattice.segments:
                    cuts = lattice.cuts
                    zones_.append((lattice, {k: gold_at[cuts[i], cuts[j]] for k, (i, j, _) in enumerate(lattice.segments) if (cuts[i], cuts[j]) in gold_at}))
    index = {f: i for i, f in enumerate(sorted({f for z, _ in zones_ for _, _, fs in z.segments for f in fs}))}
    w, seen = np.zeros((len(index), len(KINDS))), np.full((len(index), len(KINDS)), 1e-8)
    if index:
        w[index["bias"]] = -4
    for _ in range(EPOCHS):
        rng.shuffle(zones_)
        for lattice, gold in zones_:
            g = lattice.marginals(lattice.weigh(index, w))
            for k, kind in gold.items():
                g[k, kind] -= 1
            step: dict[int, np.ndarray] = {}
            for k in np.flatnonzero(np.abs(g).max(axis=1) > 1e-3).tolist():
                for f in lattice.segments[k][2]:
                    i = index[f]
                    step[i] = step[i] + g[k] if i in step else g[k].copy()
            if step:
                rows, grad = list(step), np.array(list(step.values()))
                seen[rows] += grad**2
                w[rows] -= 0.4 * grad / np.sqrt(seen[rows]) + 1e-4 * w[rows]
    return index, w


def find(text: str | None, model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans (base and added), each by start, then kind as listed."""
    if not text:
        return [], []
    base = base_spans(text)
    index, w = model
    added = []
    for a, b in zones(text, base) if index else ():
        value, spans = decode(text, a, b, index, w)
        if value >= MARGIN:
            added += spans
    if added:
        own = sorted(base)
        begins, reach = [x[0] for x in own], list(itertools.accumulate((x[1] for x in own), max))
        kept, over = list(base), 0
        for a, b, kind in sorted(set(added)):
            k = bisect.bisect_left(begins, b)
            if a < over or (k and reach[k - 1] > a):
                continue
            kept.append((a, b, kind))
            over = b
        return base, sorted(kept, key=lambda x: (x[0], x[2], x[1]))
    return base, base


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def finder(shared):
    model = shared.value

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [find(t, model) for t in batch.column("text").to_pylist()]
        names = [c for c in batch.schema.names if c != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array([sum(s[2] == k for s in base) for base, _ in rows], pa.int64()) for k in range(4)), pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], pa.string()), pa.array([listed(spans) for _, spans in rows], pa.string())], names=[*names, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return work


def masker(shared):
    model = shared.value

    def mask(text: str | None) -> str | None:
        _, spans = find(text, model)
        if not spans:
            return text
        out, at = [], 0
        for a, b, kind in spans:
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], f"[{KINDS[kind]}]"]
            at = b
        return "".join([*out, text[at:]])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        return pa.RecordBatch.from_arrays([pa.array([mask(t) for t in batch.column("text").to_pylist()], pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return work


def find_spans(docs: DataFrame, model) -> DataFrame:
    """All columns of ``docs`` but text; counts of base spans, their digest, and all spans."""
    new = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kept = [f for f in docs.schema.fields if f.name not in ("text", *new)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"n_{k} bigint" for k in KINDS] + ["base_sha256 string", "spans string"])
    return per_text(docs.select(*[f.name for f in kept], "text"), schema, finder, docs.sparkSession.sparkContext.broadcast(model))


def mask_spans(docs: DataFrame, model) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return per_text(docs, schema, masker, docs.sparkSession.sparkContext.broadcast(model))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return find_spans(docs.select("doc_id", "text"), train(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: personal data is masked; n_chars follows the text."""
    return mask_spans(docs, train(docs)).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)
