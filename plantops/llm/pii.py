"""Personal data by boosted trees over overlapping candidates.

**Base.**  Emails, IP addresses, card and phone numbers by their fixed forms;
these spans always stay.

**Candidates.**  Generators of high recall propose further spans, which may
overlap each other and the base: written-out emails, numbers in phone or card
form, assignments to words such as password, long mixed strings.

**Trees.**  Gradient-boosted trees over a candidate's form (lengths, character
classes, Luhn sum, parts) and context (neighbouring characters and words) give
a probability.  They are trained on a bounded sample of the candidates of all
documents, drawn by hash for each generator, with weak labels: a candidate is positive when a validator vouches for it (a base form,
a national phone number by its grouping or a
phone word before it, or a known secret behind a keyword), negative when a validator of its form
refuses it or nothing vouches for it; a string that may be a bare key has no
label.  The validators' own verdicts are not features, save the Luhn sum (and
for strings without a keyword of their own the keyword before them is none), so
trees generalise over form and context.

**Thresholds.**  For each generator the lowest threshold that reaches
``precision`` on documents kept out of training selects the spans to add; a
generator that never reaches it adds none.  All candidates of all such
documents that base spans do not hold already count, as an aggregation into
bins of log-odds; where none of a
generator's candidates was kept out, all that it has count.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantops.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone", "contact", "number", "secret")
Span = tuple[str, int, int]

# ---- base spans ---------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards, which is linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """A run of numbers and dots gives its parts four by four."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            n = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in four):
                out.append((at, at + n))
            at += n + 1
    return out


def base_spans(text: str) -> list[Span]:
    out = [("email", a, b) for a, b in emails(text)] + [("ip", a, b) for a, b in ips(text)]
    for m in _CARD.finditer(text):
        d = only_digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(only_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- candidates ---------------------------------------------------------

_KEYWORD = r"(?i:password|passwd|passwort|secret|token|api[_-]?key|access[_-]?key)"
GENERATORS = [
    ("contact", re.compile(r" ?[\[({] ?(?i:at) ?[\])}] ?")),  # contacts() goes outwards from it
    ("number", re.compile(r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}")),
    ("secret", re.compile(rf"\b{_KEYWORD} {{0,2}}[=:] {{0,2}}[\"']?[^\s\"']{{6,}}")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")),  # whole runs; candidates() asks for a digit in them
]
_DIGIT = re.compile("[0-9]")
_SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: ?[\[({] ?(?i:dot) ?[\])}] ?[A-Za-z0-9-]{2,}|\.[A-Za-z0-9-]{2,})+")
_VOUCHED = re.compile(rf"(?:{_KEYWORD} {{0,2}}[=:] {{0,2}}[\"']?)(?=[^\s\"']*[0-9])[^\s\"']{{8,}}|(?:AKIA|ASIA)[A-Z0-9]{{16}}$")
_KNOWN_KEY = re.compile(r"(?:gh[opsu]_|github_pat_|sk-|xox[abp]-|glpat-|AKIA|ASIA|AIza|eyJ)(?=[A-Za-z0-9+/_-]*[0-9])")
_ASSIGNED = re.compile(rf"{_KEYWORD} {{0,2}}[=:] {{0,2}}[\"']?$")
_BRACKETED_AT = re.compile(r"(?i)[\[({] ?at ?[\])}]")
_PHONE_CUE = re.compile(r"(?i)\b(?:tel|telephone|telefon|phone|call|fax|mobile|cell)\b")
# national numbers whose form is enough, and those that need a cue; dates are neither
_NATIONAL = re.compile(r"\([0-9]{2,5}\) ?[0-9]{3,4}[ -]?[0-9]{3,5}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}")
_GROUPED = re.compile(r"\(?0?[0-9]{1,5}\)?(?:[ ./-]{1,2}[0-9]{2,8}){1,4}|[0-9]{7,11}")
_DATE = re.compile(r"[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{4}")
_CUE = re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|mail|contact|ip|card|konto|visa)\b")


def contacts(text: str) -> list[tuple[int, int]]:
    """Written-out addresses, from each bracketed "at" outwards: whole runs on
    both sides, in time linear in the text."""
    out, end = [], 0
    for m in GENERATORS[0][1].finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _SPELT_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            out.append((start, domain.end()))
            end = domain.end()
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(generator, start, end)."""
    out = []
    has_digit = any(d in text for d in "0123456789")
    for g, (_, pattern) in enumerate(GENERATORS):
        if g in (1, 3) and not has_digit or g == 0 and not _BRACKETED_AT.search(text) or g == 2 and "=" not in text and ":" not in text:
            continue
        if g == 0:
            out += [(0, *span) for span in contacts(text)]
            continue
        out += [(g, *m.span()) for m in pattern.finditer(text) if g != 3 or _DIGIT.search(text, *m.span())]
    return out


BARE = 3  # the generator of strings without a keyword of their own

FEATURES = ("generator", "length", "digits", "upper", "lower", "other", "digit_share", "distinct_share", "entropy", "parts", "longest_part", "luhn",
            "plus", "brackets", "at_sign", "equals", "before", "after", "cue", "phone_cue", "assigned", "switches")


def describe(text: str, g: int, start: int, end: int) -> list[float]:
    s = text[start:end]
    n = len(s)
    count = Counter(s)
    digits, upper, lower = sum(c in "0123456789" for c in s), sum(c.isupper() for c in s), sum(c.islower() for c in s)
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", s) if p]
    kind = ["d" if c in "0123456789" else "l" if c.isalpha() else "o" for c in s]
    before, after = text[max(0, start - 24):start], text[end:end + 1]
    side = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalnum() else 3.0
    d = only_digits(s)
    return [g, n, digits, upper, lower, n - digits - upper - lower, digits / n, len(count) / n, -sum(v / n * math.log2(v / n) for v in count.values()), len(parts), max(map(len, parts), default=0),
            float(len(d) >= 12 and luhn(d)), float(s[0] == "+"), float("(" in s), float("@" in s or " at " in s.lower()), float("=" in s or ":" in s), side(before[-1:]), side(after),
            float(bool(_CUE.search(before))), float(bool(_PHONE_CUE.search(before))), float(g != BARE and bool(_ASSIGNED.search(before))), sum(a != b for a, b in zip(kind, kind[1:]))]


def numbers(base: list[Span]) -> list[list[tuple[int, int]]]:
    """The card spans and the phone spans, each by start and not overlapping."""
    return [[(a, b) for k, a, b in base if k == kind] for kind in ("card", "phone")]


def national(text: str, start: int, end: int) -> bool:
    """A phone number without country code, by its grouping and, save for the
    plainest groupings, a phone cue before it."""
    s = text[start:end]
    if not 7 <= len(only_digits(s)) <= 12 or _DATE.fullmatch(s) or text[end:end + 1].isalnum() or re.search(r"[\w.\-/+]$", text[max(0, start - 1):start]):
        return False
    return bool(_NATIONAL.fullmatch(s) or _GROUPED.fullmatch(s) and _PHONE_CUE.search(text, max(0, start - 24), start))


def whole_in(text: str, base: list[Span]):
    """A test whether base spans hold all of a stretch: it adds nothing to them."""
    free = bytearray(b"\1" * len(text))
    for _, a, b in base:
        free[a:b] = bytes(b - a)
    return lambda start, end: free.find(1, start, end) < 0


def vouched(text: str, g: int, start: int, end: int, same: list[list[tuple[int, int]]]) -> bool | None:
    """The weak label: a number that is about a base span (``same``: see
    ``numbers``) or has a national form, a secret of a known form, or a
    written-out address that ends in letters.

    Of strings without a keyword in them those behind one and those with the
    prefix of a known kind are secrets; those whose parts are all plain words
    or plain numbers are none; the others have no label (None) and train
    nothing, as they may be bare keys."""
    if g == BARE:
        if _ASSIGNED.search(text, max(0, start - 24), start) or _KNOWN_KEY.match(text, start, end):
            return True
        return None if any(p and not p.isalpha() and not p.isdigit() for p in re.split(r"[^A-Za-z0-9]+", text[start:end])) else False
    if GENERATORS[g][0] == "secret":
        return bool(_VOUCHED.match(text, start, end))
    if g == 0:
        return bool(re.search(r"[A-Za-z]{2,10}$", text[start:end]))
    # of each kind only the spans that can touch the candidate
    near = [s for spans in same for s in spans[max(0, bisect_right(spans, (start, math.inf)) - 1):bisect_left(spans, (end,))]]
    return any(a <= start and end <= b or start <= a and b <= end and b - a >= 0.8 * (end - start) for a, b in near) or national(text, start, end)


# ---- boosted trees ------------------------------------------------------

@dataclass
class Trees:
    """Trees as arrays: a row is (feature, limit, value); node i has children 2i + 1, 2i + 2."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, limit, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > limit[at])
            out += value[at]
        return np.clip(out, -35, 35)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Logistic loss, second-order leaves, splits at quantile bins (of few
    values, such as the generators, between any two)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))), [], depth)
    if len(set(y.tolist())) < 2:
        return model
    edges = [u[:-1] if len(u) <= bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j, u in enumerate(map(np.unique, x.T))]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    f, nodes = np.full(len(y), model.start), 2 ** (depth + 1) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f, -35, 35)))
        g, h = p - y, p * (1 - p)
        feature, limit, value, at = np.zeros(nodes, int), np.full(nodes, np.inf), np.zeros(nodes), np.zeros(len(y), int)
        for level in range(depth):
            for node in range(2 ** level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(at == node)
                best, total_g, total_h = 1e-6, g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    if not len(e) or len(own) < 20:
                        continue
                    gl = np.cumsum(np.bincount(binned[own, j], g[own], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h[own], len(e) + 1))[:-1]
                    gain = gl ** 2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g ** 2 / (total_h + ridge)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, feature[node], limit[node] = gain[i], j, e[i]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        gs, hs = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        value = -rate * gs / (hs + ridge)
        f += value[at]
        model.trees.append((feature, limit, value))
    return model


@dataclass
class Finder:
    """Base spans and the candidates above their generator's threshold.  Added
    spans do not overlap each other; they may overlap base spans, save that
    one which lies whole in them adds nothing."""

    trees: Trees
    thresholds: list[float]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base, all), each in the order of the kinds, then of the start."""
        base = base_spans(text)
        found = candidates(text)
        added: list[Span] = []
        if found:
            p = self.trees.probability(np.array([describe(text, *c) for c in found]))
            in_base = whole_in(text, base)
            taken = bytearray(len(text))  # the characters that added spans hold: linear in a text with very many spans
            for x, (g, a, b) in sorted(zip(p, found), key=lambda t: (-t[0], t[1])):
                if x >= self.thresholds[g] and taken.find(1, a, b) < 0 and not in_base(a, b):
                    added.append((GENERATORS[g][0], a, b))
                    taken[a:b] = b"\1" * (b - a)
        rank = {k: i for i, k in enumerate(KINDS)}
        return base, sorted(base + added, key=lambda s: (rank[s[0]], s[1]))


BINS = 16  # for each unit of log-odds


def train(docs: DataFrame, train_rows: int = 40_000, precision: float = 0.98) -> Finder:
    """Trees fitted on about ``train_rows`` candidates at most, an equal number
    for each generator, drawn by hash from three quarters of the documents;
    thresholds by the candidates of all other documents.  The same documents
    always give the same model."""
    src = docs.select(F.xxhash64(F.lit(7), "doc_id", whole_text()).alias("h"), whole_text().alias("t"))

    def count(batches):
        n = Counter()
        for rb in batches:
            for h, t in zip(rb.column(0).to_pylist(), rb.column(1)):
                if not held(h):
                    n.update(c[0] for c in addable(t.as_py())[0])
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["g", "n"])

    total = dict(src.mapInArrow(count, "g int, n bigint").groupBy("g").agg(F.sum("n")).collect())
    room = train_rows // len(GENERATORS)
    share = [min(1.0, room / total[g]) if g in total else 0.0 for g in range(len(GENERATORS))]

    def draw(batches):
        for rb in batches:
            key, at, y, x = [], [], [], []
            for h, t in zip(rb.column(0).to_pylist(), rb.column(1)):
                if held(h):
                    continue
                text = t.as_py()
                found, same = addable(text)
                for c in found:
                    label = vouched(text, *c, same) if crc32(b"%d %d" % c[:2], h & 0xFFFFFFFF) < share[c[0]] * 2 ** 32 else None
                    if label is not None:
                        key.append(h)
                        at.append(c[1])
                        y.append(float(label))
                        x.append(describe(text, *c))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at, pa.int64()), pa.array(y, pa.float64()), pa.array(x, pa.list_(pa.float64()))], names=["h", "at", "y", "x"])

    # rows that repeat have the same hash, so they are drawn together; as one they keep the sample within its bound
    t = src.mapInArrow(draw, "h bigint, at bigint, y double, x array<double>").withColumn("g", F.col("x")[0]).dropDuplicates(["h", "g", "at"]).toArrow()
    trees = Trees()
    if t.num_rows:
        x = np.array(t["x"].to_pylist())
        order = np.lexsort((t["at"].to_numpy(), x[:, 0], t["h"].to_numpy()))
        trees = boost(x[order], t["y"].to_numpy()[order])
    return Finder(trees, calibrate(src, trees, precision))


def addable(text: str) -> tuple[list[tuple[int, int, int]], list[list[tuple[int, int]]]]:
    """The candidates that base spans do not hold whole, and the base ``numbers``."""
    found = candidates(text)
    base = base_spans(text) if found else []
    in_base = whole_in(text, base) if base else lambda a, b: False
    return [c for c in found if not in_base(*c[1:])], numbers(base)


def held(h: int) -> bool:
    """Whether a document, by its hash, is kept out of the trees' training."""
    return h % 4 == 0


def calibrate(src: DataFrame, trees: Trees, precision: float) -> list[float]:
    """The threshold of each generator by the candidates of ``src`` (h, t)."""
    def run(batches):
        n = Counter()
        for rb in batches:
            out, y, x = [], [], []
            for h, t in zip(rb.column(0).to_pylist(), rb.column(1)):
                text = t.as_py()
                found, same = addable(text)
                for c in found:
                    label = vouched(text, *c, same)
                    if label is not None:
                        out.append(held(h))
                        y.append(label)
                        x.append(describe(text, *c))
            if x:
                x = np.array(x)
                bins = np.floor(trees.log_odds(x) * BINS).astype(int)
                n.update(zip(x[:, 0].astype(int).tolist(), bins.tolist(), y, out))
        cols = list(zip(*n)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.bool_()), pa.array(list(n.values()), pa.int64())],
                                         names=["g", "bin", "y", "held", "n"])

    rows = src.mapInArrow(run, "g int, bin int, y boolean, held boolean, n bigint").groupBy("g", "bin", "y", "held").agg(F.sum("n").alias("n")).collect()
    thresholds = []
    for g in range(len(GENERATORS)):
        own = [r for r in rows if r.g == g]
        own = [r for r in own if r.held] or own
        right = every = 0
        best = None
        for b in sorted({r.bin for r in own}, reverse=True):
            every += sum(r.n for r in own if r.bin == b)
            right += sum(r.n for r in own if r.bin == b and r.y)
            if right >= precision * every:
                best = b
        thresholds.append(2.0 if best is None else float(1 / (1 + np.exp(-max(0, best) / BINS))))
    return thresholds


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, finder: Finder | None = None) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, the SHA-256 of
    the base spans, and all spans as text.  Null and empty texts have none;
    repeated rows each get theirs; an empty table gives no row."""
    finder = finder or train(docs)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t"))

    def run(batches):
        for rb in batches:
            n, digest, every = [[] for _ in range(4)], [], []
            for t in rb.column(1):
                base, spans = finder.spans(t.as_py())
                for i in range(4):
                    n[i].append(sum(k == KINDS[i] for k, _, _ in base))
                digest.append(hashlib.sha256(_text_of(base).encode()).hexdigest())
                every.append(_text_of(spans))
            yield pa.RecordBatch.from_arrays([rb.column(0), *[pa.array(c, pa.int64()) for c in n], pa.array(digest, pa.string()), pa.array(every, pa.string())],
                                             names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return src.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def cover(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by the kind of the first."""
    out, at, end, kind = [], 0, -1, ""
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            if kind:
                out.append(f"[{kind.upper()}]")
                at = end
            out.append(text[at:a])
            at, end, kind = a, b, k
        else:
            end = max(end, b)
    if kind:
        out.append(f"[{kind.upper()}]")
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, finder: Finder | None = None) -> DataFrame:
    """``docs`` with the spans of each text replaced by their kind; n_chars,
    where there is such a column, follows the text.  Null texts stay null."""
    finder = finder or train(docs)
    at, n = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for rb in batches:
            cols = list(rb.columns)
            texts = [None if t is None else cover(t, finder.spans(t)[1]) for t in (x.as_py() for x in rb.column(at))]
            cols[at] = pa.array(texts, cols[at].type)
            if n is not None:
                cols[n] = pa.array([old if t is None else len(t) for t, old in zip(texts, cols[n].to_pylist())], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names=rb.schema.names)

    return docs.mapInArrow(run, docs.schema)
