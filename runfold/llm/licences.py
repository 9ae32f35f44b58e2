"""Licence scans with a generalised suffix automaton of licence tokens.

The templates' words are put into one suffix automaton. A text's words are streamed
through it; the matching statistics say, for every word, the longest run ending there
that stands in some template. Runs that can't be lengthened and have ``MIN_MATCH``
words or more are placed in every template that holds them and chained: per template,
matches in text order and template order, no more than ``MAX_GAP`` words apart. The chains that
cover most template words are taken out one after the other; each that covers
``MIN_COVER`` of its template, or ``LONG_SPAN`` words of it, is a span and gives the
template's label, so a text that holds a licence five times has five spans. The base
phrases are templates as well: a phrase ends at a word where the phrase's state lies on
the suffix links of the word's state and the match is as long as the phrase.

The score is the largest share of a template that a span covers, 1 for a base phrase.

Only runs of words all of whose neighbours also neighbour in some template can match
more than one word; the rest is passed over with array operations.

Defined results: null counts as empty; no word gives zero counts, null places, empty
labels, score 0; every row is scanned alone; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm.common import table
from runfold.llm.licence_texts import PHRASES, TEMPLATES

MIN_MATCH = 4
MAX_GAP = 8
MIN_COVER = 0.6
LONG_SPAN = 25
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case, as UTF-8."""
    return _WORD.findall(text.encode("utf-8", "replace").lower())


@dataclass
class Automaton:
    """Generalised suffix automaton: per state its transitions, suffix link, longest
    length and the places (template, end) where its strings end."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, word: int) -> int:
        """The state for the longest string of ``p`` plus ``word``, cloned if the
        present one holds longer strings."""
        q = self.step[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, template: int, tokens: list[int]) -> None:
        last = 0
        for at, word in enumerate(tokens):
            if word in self.step[last]:
                last = self._split(last, word)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and word not in self.step[p]:
                    self.step[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word)
                last = new
            self.ends[last].append((template, at))

    def close(self) -> None:
        """Pass every place on to the suffixes that end there too."""
        for s in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]].extend(self.ends[s])
        for s, places in enumerate(self.ends):
            self.ends[s] = sorted(set(places))

    def find(self, tokens: list[int]) -> int:
        s = 0
        for word in tokens:
            s = self.step[s][word]
        return s


class Scanner:
    """The automaton over phrases and templates, and what is read off it."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        texts = [(label, p) for label, p in phrases.items()] + [(label, t) for label, ts in templates.items() for t in ts]
        self.n_phrases = len(phrases)
        self.labels = [label for label, _ in texts]
        tokens = [words(t) for _, t in texts]
        self.id = {w: i for i, w in enumerate(dict.fromkeys(w for ws in tokens for w in ws))}
        ids = [[self.id[w] for w in ws] for ws in tokens]
        self.size = [len(x) for x in ids]
        self.automaton = Automaton()
        for k, x in enumerate(ids):
            self.automaton.add(k, x)
        self.automaton.close()
        # phrases that end where a state's longest string ends: those on its suffix links
        at = {self.automaton.find(ids[k]): k for k in range(self.n_phrases)}
        self.phrases_of: list[tuple[int, ...]] = []
        for s in range(len(self.automaton.step)):
            found, p = [], s
            while p > 0:
                if p in at:
                    found.append(at[p])
                p = self.automaton.link[p]
            self.phrases_of.append(tuple(found))
        n = len(self.id) + 1  # the last is any other word
        self.follows = np.zeros((n, n), dtype=bool)
        for x in ids:
            self.follows[x[:-1], x[1:]] = True

    def encode(self, text: str) -> np.ndarray:
        other, get = len(self.id), self.id.get
        return np.array([get(w, other) for w in words(text)], dtype=np.int32)

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words each of which follows the one before in a template."""
        ok = self.follows[ids[:-1], ids[1:]]
        if ok.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
            yield from zip(edge[::2].tolist(), (edge[1::2] + 1).tolist())

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(state, match length) at each token."""
        a, s, n, out = self.automaton, 0, 0, []
        for word in tokens:
            while s and word not in a.step[s]:
                s = a.link[s]
                n = a.length[s]
            if word in a.step[s]:
                s, n = a.step[s][word], n + 1
            out.append((s, n))
        return out

    def scan(self, text: str) -> dict:
        ids = self.encode(text)
        places: list[tuple[int, int]] = []  # (first word, phrase)
        matches: dict[int, list[tuple[int, int, int]]] = {}  # template: (start in text, start in template, words)
        for lo, hi in self.runs(ids) if len(ids) > 1 else ():
            stats = self.statistics(ids[lo:hi].tolist())
            for i, (s, n) in enumerate(stats):
                places += [(lo + i + 1 - self.size[k], k) for k in self.phrases_of[s] if n >= self.size[k]]
                if n >= MIN_MATCH and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                    for k, end in self.automaton.ends[s]:
                        if end + 1 >= n:
                            matches.setdefault(k, []).append((lo + i + 1 - n, end + 1 - n, n))
        base = {self.labels[k] for _, k in places}
        score, spans = 1.0 if places else 0.0, []
        for k, found in matches.items():
            if k >= self.n_phrases:
                best, all_ = chains(found, MAX_GAP + self.size[k], min(MIN_COVER * self.size[k], LONG_SPAN))
                score = max(score, best / self.size[k])
                spans += [(k, *c) for c in all_]
        return {"n_words": len(ids), "n_base": len(places), "first_word": min((p for p, _ in places), default=None),
                "last_word": max((p for p, _ in places), default=None), "base_labels": sorted(base),
                "labels": sorted(base | {self.labels[k] for k, *_ in spans}), "score": score,
                "spans": [(self.labels[k], lo, hi, covered / self.size[k]) for k, lo, hi, covered in sorted(spans)]}


Match = tuple[int, int, int]  # start in text, start in template, words


def linked(a: Match, b: Match) -> int | None:
    """Words of the template that ``b`` adds when it follows ``a``, None where it can't."""
    gap, gap_t = b[0] - a[0] - a[2], b[1] - a[1] - a[2]
    if a[0] < b[0] and a[1] < b[1] and gap <= MAX_GAP and gap_t <= MAX_GAP:
        return b[2] - max(0, -min(gap, gap_t))
    return None


def heaviest(found: list[Match], back: int) -> tuple[list[int], list[int]]:
    """Per match (sorted) the words covered by the best chain that ends with it, and the
    match before it in that chain (-1: none). A match that ends within the gap starts at
    most ``back`` (template words and gap) before, so long texts stay linear."""
    covered, before = [], []
    for j, b in enumerate(found):
        most, prev = b[2], -1
        for i in range(j - 1, -1, -1):
            if b[0] - found[i][0] > back:
                break
            more = linked(found[i], b)
            if more is not None and covered[i] + more > most:
                most, prev = covered[i] + more, i
        covered.append(most)
        before.append(prev)
    return covered, before


def chains(found: list[Match], back: int, least: float) -> tuple[int, list[tuple[int, int, int]]]:
    """The words covered by the best chain, and every chain of at least ``least`` words as
    (first word, end, covered words): the heaviest first, each match used once, matches
    inside a reported span gone with it. A chain that meets a used match ends there, and
    the rest is chained anew until no chain of unused matches reaches ``least``."""
    found, best, out = sorted(found), 0, []
    while found:
        covered, before = heaviest(found, back)
        best = max(best, max(covered))
        used, n_out = bytearray(len(found)), len(out)
        for end in sorted(range(len(found)), key=lambda j: (-covered[j], j)):
            if covered[end] < least:
                break
            if used[end]:
                continue
            members = [end]
            while before[members[-1]] >= 0 and not used[before[members[-1]]]:
                members.append(before[members[-1]])
            first = members[-1]
            words_ = covered[end] - (covered[before[first]] if before[first] >= 0 else 0)
            if words_ < least:
                continue
            lo, hi = found[first][0], max(found[j][0] + found[j][2] for j in members)
            out.append((lo, hi, words_))
            for i in range(bisect.bisect_left(found, (lo,)), bisect.bisect_left(found, (hi,))):
                used[i] = used[i] or found[i][0] + found[i][2] <= hi
        if len(out) == n_out:
            break
        found = [m for m, gone in zip(found, used) if not gone]
    return best, sorted(out)


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label: string, first_word: long, end_word: long, covered: double>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
         templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document: base counts, labels, score and covered spans."""
    scanner = Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [scanner.scan(t or "") for t in b.column(1).to_pylist()]
            col = {k: [f[k] for f in found] for k in ("n_words", "n_base", "first_word", "last_word")}
            span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()),
                              ("covered", pa.float64())])
            spans = [[dict(zip(("label", "first_word", "end_word", "covered"), s)) for s in f["spans"]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(v, pa.int64()) for v in col.values()),
                 *(pa.array([",".join(f[k]) for f in found], pa.string()) for k in ("base_labels", "labels")),
                 pa.array([f["score"] for f in found], pa.float64()), pa.array(spans, pa.list_(span))],
                names=[id_col, *col, "base_labels", "labels", "score", "spans"])
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {RESULT}")


def op9_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")
