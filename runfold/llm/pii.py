"""Personal data: base patterns, and a semi-Markov conditional random field that adds
spans the patterns don't cover (obfuscated mail addresses, phone numbers without a plus,
cards and addresses with other separators, secrets).

The field works on regions: runs of neighbouring tokens that hold a digit or an ``@``, with
``CONTEXT`` tokens around. A region is split into atoms (runs of letters, runs of digits,
single characters). Every stretch of at most ``MAX_ATOMS`` atoms that has the outer form of
a kind is a candidate segment of that kind; features look at the whole span (digit count
and grouping, separators, check digit, octets, entropy, both edges, the words before). A
labelling of the region is a set of disjoint candidates; forward sums over all labellings
train the weights (conditional log-likelihood, seeded), Viterbi picks boundaries and kinds
jointly. Both are linear in the region's length, as entities are bounded.

It is fitted on generated lines (every kind in clear and obfuscated forms, and numbers that
are none of them) and on regions of about ``SAMPLE_DOCS`` documents, chosen by hash, labelled
by the base patterns: a bounded sample, whatever the size of the table.

Base spans always stay; a found span is added where it overlaps no base span.

Defined results: null counts as empty; an empty text has no span (the digest of the empty
string); every row is searched alone and whole; extra columns are ignored; an empty table
gives an empty result and leaves the generated lines to learn from.
"""

from __future__ import annotations

import bisect
import itertools
import math
import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm.common import table

KINDS = ["email", "ip", "card", "phone"]
ORDER = {k: i for i, k in enumerate([*KINDS, "secret"])}
MAX_ATOMS = 48
CONTEXT = 3
REACH = 200
SAMPLE_DOCS = 2000
REGIONS = 10
_SECRET = re.compile(r"(?i)(?:token|key|secret|password) ?[=:] ?[\"']([A-Za-z0-9_/+-]{16,80})[\"']")

Span = tuple[str, int, int]


# --------------------------------------------------------------- base patterns
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# digit runs are entered at their first digit only and never re-read: linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = [(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in string.digits)


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        host = _HOST.match(text, at + 1) if lo < at else None
        if host:
            yield "email", lo, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The contract's patterns, leftmost and non-overlapping per kind, by start."""
    found = list(emails(text))
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = digits_of(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


# ------------------------------------------------------------------- regions
_TRIGGER = re.compile(r"[^\x00-\x2F\x3A-\x3F\x41-￿\U00010000-\U0010FFFF]")  # a digit or @
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]", re.S)
_SPELLED = re.compile(r"(?i)[\[(](?:at|dot)[\])]|(?<= )dot(?= )")
_SPELLED_HINTS = ("[at]", "(at)", " dot ", "(dot)", "[dot]")


def spelled_out(text: str) -> bool:
    lower = text.lower()
    return any(x in lower for x in _SPELLED_HINTS)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around tokens with a digit, an ``@`` or a spelled-out mail address."""
    marks = [m.start() for m in _TRIGGER.finditer(text)]
    if spelled_out(text):
        marks = sorted({*marks, *(m.start() for m in _SPELLED.finditer(text))})
    hold: tuple[int, int] | None = None
    seen = 0  # end of the last marked token
    for p in marks:
        if p < seen:
            continue
        lo, hi = p, p
        for _ in range(CONTEXT):
            lo = max(text.rfind(" ", max(0, lo - REACH), max(0, lo - 1)), text.rfind("\n", max(0, lo - REACH), max(0, lo - 1)), 0, lo - REACH)
        for i in range(CONTEXT):
            ends = [e for e in (text.find(" ", hi + 1, hi + REACH), text.find("\n", hi + 1, hi + REACH)) if e >= 0]
            hi = min(ends) if ends else min(len(text), hi + REACH)
            seen = hi if i == 0 else seen
        if hold and lo <= hold[1]:
            hold = (hold[0], max(hi, hold[1]))
        else:
            if hold:
                yield hold
            hold = (lo, hi)
    if hold:
        yield hold


AT = r"(?:@| ?\[at\] ?| ?\(at\) ?| at )"
DOT = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot |\[\.\])"
FORMS = {
    "email": re.compile(rf"(?i)[a-z0-9][a-z0-9._%+-]*{AT}[a-z0-9-]+(?:{DOT}[a-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}|(?i:[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){3,7})"),
    "card": re.compile(r"[0-9](?:[ ./_-]?[0-9]){12,18}"),
    "phone": re.compile(r"(?:\+|00|\()?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}"),
    "secret": re.compile(r"[A-Za-z0-9_/+-]{16,80}={0,2}"),
}
TLDS = frozenset("com org net edu gov mil int info biz io dev app ai eu de fr es it uk us ca au jp cn in br ru nl pl ch at be se".split())
LEXICON = {
    "phone": "phone tel telephone call fax mobile cell whatsapp sms number dial".split(),
    "email": "mail email e contact write reach".split(),
    "ip": "ip host server address addr client from".split(),
    "card": "card visa mastercard amex credit debit pay payment".split(),
    "secret": "token key secret password passwd api apikey bearer auth".split(),
    "plain": "version v chapter page section figure table year isbn order no cc by item line row id".split(),
}
CLASS_OF = {w: k for k, ws in LEXICON.items() for w in ws}


def features(kind: str, text: str, lo: int, hi: int, left: int, right: int) -> list[str]:
    """Whole-span features of text[lo:hi] as ``kind`` in the region left..right."""
    s = text[lo:hi]
    digits = digits_of(s)
    f = ["bias", f"digits{min(len(digits), 20)}", f"before{_edge(text, lo - 1, left)}", f"after{_edge(text, hi, right)}"]
    for w in re.findall(r"[A-Za-z]+", text[max(left, lo - 40):lo])[-3:]:
        if w.lower() in CLASS_OF:
            f.append(f"word:{CLASS_OF[w.lower()]}")
    if kind == "email":
        f += [f"at:{'@' in s}", f"spelled:{bool(re.search(r'(?i)[\[(]at|[\[(]dot| dot ', s))}",
              f"tld:{s.rsplit('.')[-1].rsplit(' ')[-1].rsplit(']')[-1].lower() in TLDS}", f"spaces{min(3, s.count(' '))}",
              f"more:{bool(re.match(DOT + '[A-Za-z0-9]', text[hi:min(right, hi + 12)]))}"]
    elif kind == "ip":
        parts = re.findall("[0-9]+", s)
        f += [f"octets:{':' not in s and all(int(p) <= 255 for p in parts)}", f"six:{':' in s and len(s) >= 11}",
              f"clock:{':' in s and len(s) < 11}"]
    elif kind == "card":
        f += [f"luhn:{luhn(digits)}", f"long:{14 <= len(digits) <= 19}",
              f"four:{bool(re.fullmatch('([0-9]{4}[ ./_-]?){3}[0-9]{2,7}', s))}", f"issuer:{digits[0] in '3456'}"]
    elif kind == "phone":
        groups = re.findall("[0-9]+", s)
        f += [f"lead:{s[0] if s[0] in '+(' else s[:2] == '00'}", f"groups{min(5, len(groups))}", f"paren:{s.count('(') == s.count(')')}",
              f"bare:{s.isdigit()}", f"shape:{'-'.join(str(min(5, len(g))) for g in groups)}",
              f"date:{bool(re.fullmatch('(19|20)[0-9]{2}([./-])[0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}[./-][0-9]{2,4}', s))}",
              f"years:{bool(re.fullmatch('[12][0-9]{3}[ -][12][0-9]{3}', s))}"]
    else:
        kinds = sum(bool(re.search(c, s)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
        counts = [s.count(c) / len(s) for c in set(s)]
        f += [f"kinds{kinds}", f"hex:{bool(re.fullmatch('(?i)[0-9a-f]+', s))}", f"entropy{int(-sum(c * math.log2(c) for c in counts))}",
              f"quoted:{lo > left and text[lo - 1] in chr(34) + chr(39)}", f"long{min(6, len(s) // 8)}",
              f"mixed:{bool(re.search('[0-9]', s)) and bool(re.search('[A-Za-z]', s))}"]
    return [f"{kind}|{x}" for x in f]


def _edge(text: str, i: int, bound: int) -> str:
    if not 0 <= i < len(text) or i == bound:
        return "end"
    c = text[i]
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+-./@:_=%" else "mark"


def candidates(text: str, lo: int, hi: int) -> tuple[list[int], dict[int, list[tuple[int, str]]]]:
    """Atom bounds of a region, and per atom the segments that end behind it, as
    (first atom, kind)."""
    bounds = [lo + m.start() for m in _ATOM.finditer(text[lo:hi])] + [hi]
    ends: dict[int, list[tuple[int, str]]] = {}
    at = {b: i for i, b in enumerate(bounds)}
    for i in range(len(bounds) - 1):
        first = text[bounds[i]]
        if not (first.isalnum() and first.isascii() or first in "+("):
            continue
        reach = bounds[min(i + MAX_ATOMS, len(bounds) - 1)]
        for kind, form in FORMS.items():
            m = form.match(text, bounds[i], reach)
            if not m:
                continue
            # the greedy end, and shorter ones that still have the form
            for j in range(at.get(m.end(), 0), i, -1):
                if j == at.get(m.end()) or (kind != "secret" and form.fullmatch(text, bounds[i], bounds[j])):
                    ends.setdefault(j, []).append((i, kind))
    return bounds, ends


class Field:
    """The weights, and inference over a region's candidate segments."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, feats: list[str]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in feats)

    def best(self, text: str, lo: int, hi: int) -> list[Span]:
        """Viterbi: the labelling of the region with the highest score."""
        bounds, ends = candidates(text, lo, hi)
        if not ends:
            return []
        value, back = [0.0] * len(bounds), [None] * len(bounds)
        for j in range(1, len(bounds)):
            value[j] = value[j - 1]
            for i, kind in ends.get(j, ()):
                v = value[i] + self.score(features(kind, text, bounds[i], bounds[j], lo, hi))
                if v > value[j]:
                    value[j], back[j] = v, (i, kind)
        found, j = [], len(bounds) - 1
        while j > 0:
            if back[j]:
                i, kind = back[j]
                found.append((kind, bounds[i], bounds[j]))
                j = i
            else:
                j -= 1
        return found[::-1]

    def spans(self, text: str) -> list[Span]:
        return [s for lo, hi in regions(text) for s in self.best(text, lo, hi)]


# ------------------------------------------------------------------ training
def _number(rng: random.Random, n: int) -> str:
    return str(rng.randrange(10 ** (n - 1), 10**n))


def _card(rng: random.Random, valid: bool = True) -> str:
    d = _number(rng, 15)
    return d + next(c for c in string.digits if luhn(d + c) == valid)


def generated(seed: int = 11, n: int = 700) -> list[tuple[str, list[Span]]]:
    """Lines with their spans: every kind in clear and obfuscated, and plain numbers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustrnlmdchpg") for _ in range(rng.randrange(2, 9)))
    four = lambda d, s: s.join(d[i:i + 4] for i in range(0, 16, 4))
    octet = lambda: str(rng.randrange(256))
    host = lambda d: d.join([word(), *(word() for _ in range(rng.randrange(2))), rng.choice(["com", "org", "net", "de"])])
    digest = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    make = {
        "email": [lambda: f"{word()}.{_number(rng, 2)}@{host('.')}", lambda: f"{word()} at {host(' dot ')}",
                  lambda: f"{word()}{_number(rng, 2)}[at]{host('[dot]')}", lambda: f"{word()} (at) {host(' (dot) ')}",
                  lambda: f"{word()}_{word()} [at] {host('.')}"],
        "ip": [lambda: ".".join(octet() for _ in range(4)), lambda: "[.]".join(octet() for _ in range(4)),
               lambda: ":".join(digest(4) for _ in range(8))],
        "card": [lambda: _card(rng), lambda: four(_card(rng), " "), lambda: four(_card(rng), "."), lambda: four(_card(rng), "/"),
                 lambda: four(_card(rng), "-")],
        "phone": [lambda: f"+{_number(rng, 1)} ({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}",
                  lambda: f"({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}",
                  lambda: f"{_number(rng, 3)}-{_number(rng, 3)}-{_number(rng, 4)}", lambda: f"{_number(rng, 3)}.{_number(rng, 3)}.{_number(rng, 4)}",
                  lambda: f"0049 {_number(rng, 3)} {_number(rng, 7)}", lambda: f"+{_number(rng, 12)}"],
        "secret": [lambda: digest(40), lambda: digest(40).upper(), lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))],
    }
    plain = [lambda: _number(rng, rng.randrange(1, 9)), lambda: f"{_number(rng, 1)}.{rng.randrange(10)}", lambda: _card(rng, False),
             lambda: f"20{rng.randrange(10, 30)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}", lambda: f"{rng.randrange(10, 24)}:{rng.randrange(10, 60)}",
             lambda: f"{_number(rng, 1)}.{_number(rng, 1)}.{_number(rng, 2)}", lambda: f"{_number(rng, 3)}.{_number(rng, 3)}.{rng.randrange(256, 999)}.{_number(rng, 3)}",
             lambda: f"{_number(rng, 2)},{_number(rng, 3)}", lambda: _number(rng, rng.randrange(10, 14)), lambda: f"{word()} at {word()}",
             lambda: four(_card(rng, False), " "), lambda: f"{_number(rng, 4)} {_number(rng, 4)}", lambda: f"@{word()}", lambda: word() + word() + word() + word(),
             lambda: f"{_number(rng, 4)}-{_number(rng, 4)}", lambda: f"{word()}-{_number(rng, 3)}", lambda: _number(rng, rng.randrange(20, 30)),
             lambda: f"{_number(rng, 3)} {_number(rng, 3)} {_number(rng, 3)}"]
    out = []
    for _ in range(n):
        text, spans = word(), []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice([*make, "plain", "plain", "plain", "plain"])
            hint = rng.random() < 0.3
            text += "".join(f" {word()}" for _ in range(rng.randrange(4))) + (f" {rng.choice(LEXICON[kind])}" if hint else "") \
                + rng.choice([" ", " ", ": ", ' = "' if kind == "secret" else " "])
            value = rng.choice(make[kind] if kind in make else plain)()
            if kind in make:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + rng.choice(["", "", ".", ",", '"' if kind == "secret" else ""]) + f" {word()}"
        out.append((text, spans))
    return out


def train(lines: list[tuple[str, list[Span]]], epochs: int = 8, rate: float = 0.5, decay: float = 1e-3, seed: int = 3) -> Field:
    """Conditional log-likelihood by stochastic gradient over regions: observed minus
    expected features, the expectation by forward and backward sums over segments."""
    problems = []
    for text, spans in lines:
        for lo, hi in regions(text):
            bounds, ends = candidates(text, lo, hi)
            gold = {(a, b, k) for k, a, b in spans}
            segs = [(i, j, features(k, text, bounds[i], bounds[j], lo, hi), (bounds[i], bounds[j], k) in gold)
                    for j, starts in ends.items() for i, k in starts]
            if segs:
                problems.append((len(bounds), sorted(segs, key=lambda s: (s[1], s[0]))))
    w: dict[str, float] = {}
    field, rng, step = Field(w), random.Random(seed), 0
    for _ in range(epochs):
        rng.shuffle(problems)
        for n, segs in problems:
            step += 1
            scores = [min(30.0, max(-30.0, field.score(f))) for _, _, f, _ in segs]
            alpha, beta = [0.0] * n, [0.0] * n  # log sums over labellings before and behind a bound
            k = 0
            for j in range(1, n):
                terms = [alpha[j - 1]]
                while k < len(segs) and segs[k][1] == j:
                    terms.append(alpha[segs[k][0]] + scores[k])
                    k += 1
                alpha[j] = _logsum(terms)
            by_start = sorted(range(len(segs)), key=lambda s: -segs[s][0])
            k = 0
            for i in range(n - 2, -1, -1):
                terms = [beta[i + 1]]
                while k < len(by_start) and segs[by_start[k]][0] == i:
                    terms.append(beta[segs[by_start[k]][1]] + scores[by_start[k]])
                    k += 1
                beta[i] = _logsum(terms)
            eta = rate / math.sqrt(1 + step / len(problems))
            for (i, j, feats, is_gold), s in zip(segs, scores):
                g = is_gold - math.exp(alpha[i] + s + beta[j] - alpha[n - 1])
                if abs(g) > 1e-4:
                    for f in feats:
                        w[f] = w.get(f, 0.0) * (1 - eta * decay) + eta * g
    return field


def _logsum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def sample_lines(docs: DataFrame, id_col: str, text_col: str, n: int = SAMPLE_DOCS) -> list[tuple[str, list[Span]]]:
    """Regions of about ``n`` documents (a share of all, by hash), labelled by the base
    patterns; ``REGIONS`` of a document at most. Regions are cut and labelled where the
    documents are; the driver gets some lines per sampled document, no text whole."""
    total = docs.count()
    spot = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("personal data")), F.lit(1 << 30)) / float(1 << 30)
    some = docs.filter(spot < n / max(1, total)).select(F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                base = base_spans(text or "")
                for lo, hi in itertools.islice(regions(text or ""), REGIONS):
                    inside = [(k, a - lo, b_ - lo) for k, a, b_ in base if lo <= a and b_ <= hi]
                    secrets = [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text[lo:hi])]
                    out.append((text[lo:hi], written(inside + secrets)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["line", "spans"])
    lines = some.mapInArrow(run, "line string, spans string").orderBy("line", "spans").collect()
    return [(r.line, [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]) for r in lines]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    return train(generated() + sample_lines(docs, id_col, text_col))


# -------------------------------------------------------------------- queries
def find(field: Field, text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    if not _TRIGGER.search(text) and not spelled_out(text):
        return [], []
    base = base_spans(text)
    starts = [a for _, a, _ in base]
    reach = list(itertools.accumulate((b for _, _, b in base), max))  # furthest end of a base span and those before it

    def free(s: Span) -> bool:
        before = bisect.bisect_left(starts, s[2])
        return before == 0 or reach[before - 1] <= s[1]
    return base, sorted(base + [s for s in field.spans(text) if free(s)], key=lambda s: (s[1], ORDER[s[0]]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``base`` and ``spans``, lists of kind, start, end."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [find(shared.value, t or "") for t in b.column(1).to_pylist()]
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[i]] for f in found], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=[id_col, "base", "spans"])
    kind = rows.schema[id_col].dataType.simpleString()
    each = "array<struct<kind: string, start: long, end: long>>"
    return rows.mapInArrow(run, f"`{id_col}` {kind}, base {each}, spans {each}")


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, fit(docs))
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(join(F.col("base")), 256).alias("base_sha256"),
                        join(F.col("spans")).alias("spans"))
