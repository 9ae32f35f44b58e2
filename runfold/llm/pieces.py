"""SentencePiece encoding by sampling segmentations, and decoding.

A text's lattice has an edge for every piece of the vocabulary that stands in it. With
piece probabilities, a segmentation is a path and has a probability; ``k`` distinct
paths are drawn without replacement by the Gumbel-top-k trick, top down: the whole set
of paths gets a Gumbel value; splitting a set at a lattice node, the branch that holds
its maximum keeps the value and the rest gets one truncated at it. Best-first (A*)
search over these perturbed sets, with the exact log mass of all completions as
heuristic, never backs up: each pop walks to a full path, so k paths cost k walks.

Here a set is "these pieces up to a node, then any but those tried"; the walk draws the
maximal branch at each node from the posterior, and leaves one rest per node.

The score of a path is its log inclusion probability, log(1 - exp(-exp(logp - kappa))),
kappa being the (k+1)-th largest perturbed value: divide by it for unbiased estimates.

Piece probabilities: a unigram model's scores; for a merge-ranked vocabulary, whose
scores are ranks, p is proportional to 1 / (rank + 10). A character without a piece is
its UTF-8 bytes. Lattices are built once per distinct word of a work unit of about
``UNIT`` characters (pieces never reach over a word start, which the vocabulary is
checked for; otherwise the text is one word). All random numbers are hashes of seed, row
key, sample and position: the result of a row does not depend on its neighbours.

Defined results: a null or empty text has one segmentation, the empty one, with
log probability and score 0; a text with fewer than k segmentations gives them all, score
0 (certain); rows that repeat a key and a text repeat the result; a null key is a key;
extra columns are dropped unless kept by name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from runfold.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIT = 1 << 20
SLOT_BITS = 21
SPACE_MARK = "▁"
RANK_OFFSET = 10.0
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniform(seed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), a function of seed and position."""
    z = mix(seed + (at.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def stream_of(seeds: np.ndarray, sample: int, what: int) -> np.ndarray:
    """Independent seeds for the uses of random numbers in each sample."""
    return mix(seeds + np.uint64((4 * sample + what + 1) * 0xD1B54A32D192ED03 % 2**64))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + n[i] - 1, one run after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n


class Vocabulary:
    """Pieces as a trie in arrays, their log probabilities and their bytes."""

    def __init__(self, proto: bytes):
        import sentencepiece
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = np.full(256, sp.unk_id(), dtype=np.int32)
        surface: list[bytes] = []
        normal: list[tuple[str, int]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif special[i]:
                surface.append(b"")
            else:
                surface.append(piece.encode())
                normal.append((piece, i))
        scores = np.array([sp.get_score(i) for _, i in normal])
        ranked = bool((scores == np.round(scores)).all())  # ranks are whole numbers, log probabilities are not
        logp = -np.log(np.arange(len(normal)) + RANK_OFFSET) if ranked else scores
        if ranked:
            logp = logp - np.log(np.exp(logp).sum())
        self.byte_logp = float(logp.min()) if len(logp) else -10.0
        self.logp = np.full(n, self.byte_logp)
        self.logp[[i for _, i in normal]] = logp
        step: dict[tuple[int, int], int] = {}
        end = [-1]
        for piece, i in normal:
            s = 0
            for c in piece:
                if (s, ord(c)) not in step:
                    step[s, ord(c)] = len(end)
                    end.append(-1)
                s = step[s, ord(c)]
            end[s] = i
        self.end = np.array(end, dtype=np.int32)
        keys = np.array([(s << 21) | c for s, c in step], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(step.values()), dtype=np.int32)[order]
        slot = self._slot(self.keys)  # hash table over the keys; of colliding keys one is there, the slot is marked
        self.table = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        self.table[slot] = np.arange(len(slot))
        self.shared = np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        self.goes_on = np.zeros(len(end), dtype=bool)
        self.goes_on[[s for s, _ in step]] = True
        self.first = np.full(0x110000, -1, dtype=np.int32)
        for (s, c), to in step.items():
            if s == 0:
                self.first[c] = to
        self.surface = pa.array(surface, pa.binary())
        self.surface_n = np.array([len(x) for x in surface], dtype=np.int64)
        self.apart = not any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece, _ in normal)
        self.line = self.apart and not any("\n" in piece for piece, _ in normal)
        probe = sp.decode(sp.encode("a"))
        self.prefixed = probe == "a" and sp.normalize("a").startswith(SPACE_MARK)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * GOLDEN) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def follow(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which (state, character) have a step in the trie, and where those lead."""
        keys = (state.astype(np.int64) << 21) | code
        slot = self._slot(keys)
        k = self.table[slot]
        ok = (k >= 0) & (self.keys[k] == keys)
        twice = np.flatnonzero(~ok & self.shared[slot])
        if len(twice):
            k[twice] = np.minimum(np.searchsorted(self.keys, keys[twice]), len(self.keys) - 1)
            ok[twice] = self.keys[k[twice]] == keys[twice]
        return ok, self.next[k[ok]]

    def normalised(self, text: str) -> str:
        # surrogates, which no UTF-8 holds, become "?"
        return self.sp.normalize(text.encode("utf-8", "replace").decode()) if text else ""

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words of normalised texts: their number per text, of each word its number
        among the distinct ones, and of those, in order of their first place, the sizes
        and the characters, a 0 behind each. A run of space marks begins a word, a line
        break is one, where no piece reaches over that."""
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        bound = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))])
        begins = np.zeros(len(code) + 1, dtype=bool)
        if self.apart:
            begins[:-1] = code == ord(SPACE_MARK)
            begins[1:-1] &= code[:-1] != ord(SPACE_MARK)
        if self.line:
            breaks = code == ord("\n")
            begins[:-1] |= breaks
            begins[1:] |= breaks
        begins[bound] = True
        begins[-1] = False
        at = np.flatnonzero(begins)
        n_bytes = 1 + (code > 0x7F).astype(np.int8) + (code > 0x7FF) + (code > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(n_bytes, dtype=np.int32)])
        spans = np.append(byte_at[at], byte_at[-1]).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(spans), pa.py_buffer(joined.encode())).dictionary_encode()
        word = found.indices.to_numpy().astype(np.int64)
        first = np.flatnonzero(np.diff(np.maximum.accumulate(word), prepend=-1))
        size = np.diff(np.append(at, len(code)))[first]
        chars = np.zeros(int(size.sum()) + len(size), dtype=np.int32)
        chars[spread(np.cumsum(size + 1) - size - 1, size)] = code[spread(at[first], size)]
        return np.diff(np.searchsorted(at, bound)), word, size, chars

    def bytes_of(self, ids: np.ndarray) -> bytes:
        found = self.surface.take(pa.array(ids))
        return found.buffers()[2].to_pybytes() if len(ids) else b""

    def decode(self, ids: np.ndarray) -> str:
        text = self.bytes_of(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace").replace(SPACE_MARK, " ")
        return text[1:] if self.prefixed and text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(proto: bytes) -> Vocabulary:
    return Vocabulary(proto)


class Lattices:
    """The lattices of distinct words, in arrays. Nodes are characters, each word
    with one more at its end; edges are sorted by the node they leave."""

    def __init__(self, v: Vocabulary, size: np.ndarray, code: np.ndarray):
        self.root = np.cumsum(size + 1) - size - 1
        self.size = size
        is_end = np.zeros(len(code), dtype=bool)
        is_end[self.root + size] = True
        state = v.first[code]  # the character 0 behind a word starts and goes on with nothing
        at = np.flatnonzero(state >= 0).astype(np.int32)
        state = state[at]
        levels = []  # edges of n characters: their nodes, n, their pieces
        n = 1
        while len(at):
            piece = v.end[state]
            hit = piece >= 0
            levels.append((at[hit], n, piece[hit]))
            more = v.goes_on[state]
            at, state = at[more], state[more]
            ok, state = v.follow(state, code[at + n])
            at = at[ok]
            n += 1
        single = np.zeros(len(code), dtype=bool)
        if levels:
            single[levels[0][0]] = True
        bare = np.flatnonzero(~single & ~is_end).astype(np.int32)  # characters without a piece: their bytes
        levels.append((bare, 1, -1 - code[bare]))
        count = np.zeros(len(code) + 1, dtype=np.int64)
        for src, _, _ in levels:
            count[src + 1] += 1
        self.ptr = np.cumsum(count)
        n_all, fill = int(self.ptr[-1]), self.ptr[:-1].copy()
        self.src, self.dst, self.piece = (np.empty(n_all, dtype=np.int32) for _ in range(3))
        for src, n, piece in levels:
            e = fill[src]
            fill[src] += 1
            self.src[e], self.dst[e], self.piece[e] = src, src + n, piece
        del levels, fill, state, at
        chars = -1 - self.piece[self.piece < 0]
        self.n_ids = None
        logp = v.logp[np.maximum(self.piece, 0)]
        if len(chars):
            n_bytes = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
            self.n_ids = np.ones(n_all, dtype=np.int8)
            self.n_ids[self.piece < 0] = n_bytes
            logp[self.piece < 0] = n_bytes * v.byte_logp
        mass = np.zeros(len(code))  # log mass of all completions
        self.n_edges = np.diff(self.ptr)
        # nodes by their distance from the word's end, and their edges in that order
        far = np.repeat(self.root + size, size + 1) - np.arange(len(code))
        far = far.astype(np.uint16 if int(size.max(initial=0)) < 1 << 16 else np.int64)
        nodes = np.argsort(far, kind="stable")
        level = np.cumsum(np.bincount(far))
        n_edges = self.n_edges[nodes]
        e = spread(self.ptr[nodes], n_edges)
        behind = np.concatenate([[0], np.cumsum(n_edges)])
        own, dst = logp[e], self.dst[e]
        for lo, hi in zip(level[:-1], level[1:]):
            node, n = nodes[lo:hi], n_edges[lo:hi]
            part = slice(behind[lo], behind[hi])
            start = behind[lo:hi] - behind[lo]
            value = own[part] + mass[dst[part]]
            top = np.maximum.reduceat(value, start)
            value -= np.repeat(top, n)
            mass[node] = top + np.log(np.add.reduceat(np.exp(value, out=value), start))
        del far, nodes, e, behind, own, dst
        self.cond = np.minimum(logp + mass[self.dst] - mass[self.src], 0.0)  # log posterior of an edge at its node
        self.cum = np.concatenate([[0.0], np.cumsum(np.exp(self.cond))])

    def rest(self, edges: np.ndarray) -> np.ndarray:
        """Log posterior of all other edges at an edge's node."""
        share = -np.expm1(self.cond[edges])
        open_ = (self.n_edges[self.src[edges]] > 1) & (share > 0)
        return np.where(open_, np.log(np.maximum(share, 1e-300)), -np.inf)

    def walk(self, node: np.ndarray, base: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each start node to its word's end, each edge drawn from the posterior.
        Returns the edges, walk after walk, and their number per walk. A node's place
        in its text is the node plus ``base``."""
        order = np.argsort(node, kind="stable")  # neighbours in memory are walked together
        node, base, seed = node[order], base[order], seed[order]
        n, steps = np.zeros(len(node), dtype=np.int64), []
        on = np.flatnonzero(self.n_edges[node] > 0)
        while len(on):
            at = node[on]
            lo, hi = self.ptr[at], self.ptr[at + 1]
            low = self.cum[lo]
            mark = low + uniform(seed[on], at + base[on]) * (self.cum[hi] - low)
            e, beyond = lo, np.flatnonzero((self.cum[lo + 1] <= mark) & (lo + 1 < hi))
            while len(beyond):  # a node has few edges
                e[beyond] += 1
                now = e[beyond]
                beyond = beyond[(self.cum[now + 1] <= mark[beyond]) & (now + 1 < hi[beyond])]
            steps.append((on, e))
            node[on] = self.dst[e]
            n[on] += 1
            on = on[self.n_edges[node[on]] > 0]
        n_out = np.empty_like(n)
        n_out[order] = n
        start = (np.cumsum(n_out) - n_out)[order]
        out = np.empty(int(n.sum()), dtype=np.int64)
        for t, (who, e) in enumerate(steps):
            out[start[who] + t] = e
        return out, n_out

    def ids(self, v: Vocabulary, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and how many each edge has."""
        piece = self.piece[edges]
        n = np.ones(len(edges), dtype=np.int64) if self.n_ids is None else self.n_ids[edges].astype(np.int64)
        if self.n_ids is None or (piece >= 0).all():
            return piece, n
        start = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.int32)
        plain = piece >= 0
        out[start[plain]] = piece[plain]
        one = ~plain & (n == 1)  # ASCII, such as line breaks
        out[start[one]] = v.byte_id[-1 - piece[one]]
        for i in np.flatnonzero(~plain & ~one):
            out[start[i]:start[i] + n[i]] = v.byte_id[list(chr(-1 - int(piece[i])).encode())]
        return out, n


class _Path:
    """A sampled path: its edges, log probability before each edge and after all, the
    perturbed value, and from ``since`` on the values of the rests beside it."""

    __slots__ = ("edges", "before", "logp", "value", "since", "rests", "tried", "words", "best")

    def __init__(self, edges, before, logp, value, since, rests, words):
        self.edges, self.before, self.logp, self.value = edges, before, logp, value
        self.since, self.rests, self.words, self.tried, self.best = since, rests, words, {}, None

    def top(self) -> float:
        """The largest value of its rests."""
        if self.best is None:
            self.best = float(self.rests.max(initial=-np.inf))
        return self.best


def truncated(loc: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at location ``loc``, truncated at ``top``."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(np.isneginf(loc), -np.inf, loc - np.log(np.exp(np.minimum(loc - top, 700.0)) - np.log(u)))


def sample_unit(v: Vocabulary, texts: list[str], keys: list[str], k: int, seed: int) -> list[list[tuple]]:
    """Per text up to ``k`` tuples (ids, log probability, log inclusion, perturbed
    value, whether the ids give the normalised text back)."""
    normal = [v.normalised(t) for t in texts]
    n_words, word, size, chars = v.words(normal)
    lat = Lattices(v, size, chars)
    del size, chars
    doc = np.repeat(np.arange(len(texts)), n_words)
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    root = lat.root[word]
    place = np.cumsum(lat.size[word]) - lat.size[word]  # of a word in its text
    base = place - (place[np.minimum(first_word[:-1], max(0, len(place) - 1))][doc] if len(place) else 0) - root
    seeds = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode("utf-8", "replace"), digest_size=8).digest(), "little")
                      for key in keys], dtype=np.uint64)

    def stream(s: int, what: int) -> np.ndarray:
        return stream_of(seeds, s, what)

    paths: list[list[_Path]] = [[] for _ in texts]
    value = -np.log(-np.log(uniform(stream(0, 0), np.zeros(len(texts), dtype=np.int64))))

    def extend(s: int, docs: np.ndarray, head: list, walks: np.ndarray, n_walks: np.ndarray, starts: np.ndarray) -> None:
        """Walk on for each of ``docs`` and record its path. ``head``: the path so far
        as (edges, before, logp, words); ``walks``: the words to walk, doc after doc."""
        owner = np.repeat(docs, n_walks)
        edges, n_edges = lat.walk(starts, base[walks], stream(s, 1)[owner])
        ends = np.concatenate([[0], np.cumsum(n_edges)])
        bound = ends[np.concatenate([[0], np.cumsum(n_walks)])]
        at_word = np.repeat(walks, n_edges)
        cond = lat.cond[edges]
        total = np.concatenate([[0.0], np.cumsum(cond)])
        whose = np.repeat(np.arange(len(docs)), np.diff(bound))
        logp0 = np.array([h[2] for h in head])
        before = total[:-1] - total[bound[:-1]][whose] + logp0[whose]
        u = uniform(stream(s, 2)[docs][whose], lat.src[edges] + base[at_word])
        rests = truncated(before + lat.rest(edges), value[docs][whose], u)
        for i, d in enumerate(docs):
            a, b = bound[i], bound[i + 1]
            e0, b0, l0, w0 = head[i]
            paths[d].append(_Path(np.concatenate([e0, edges[a:b]]), np.concatenate([b0, before[a:b]]),
                                  l0 + total[b] - total[a], value[d], len(e0), rests[a:b], np.concatenate([w0, at_word[a:b]])))

    none, some = np.zeros(0, dtype=np.int64), np.zeros(0)
    extend(0, np.arange(len(texts)), [(none, some, 0.0, none)] * len(texts), np.arange(len(word)), n_words, root)
    kappa = np.full(len(texts), -np.inf)
    for s in range(1, k + 1):
        opened: list[tuple[int, _Path, int]] = []  # text, path, and the edge whose rest has the next value
        for d, found in enumerate(paths):
            if len(found) < s:
                continue  # no further segmentation
            best = max(found, key=_Path.top)
            j = int(best.rests.argmax()) if len(best.rests) else -1
            if j < 0 or best.rests[j] == -np.inf:
                continue
            if s == k:
                kappa[d] = best.rests[j]
            else:
                value[d] = best.rests[j]
                opened.append((d, best, best.since + j))
        if not opened:
            continue
        docs = np.array([d for d, _, _ in opened])
        where = np.array([j for _, _, j in opened])
        u = uniform(stream(s, 3)[docs], 2 * where).tolist()
        head, starts, walks, n_walks, locs = [], [], [], [], []
        for (d, path, j), u1 in zip(opened, u):
            # open the rest beside edge j: draw among the edges not tried
            edge, w = int(path.edges[j]), int(path.words[j])
            node = int(lat.src[edge])
            tried = path.tried.setdefault(j, {edge})
            left = [e for e in range(int(lat.ptr[node]), int(lat.ptr[node + 1])) if e not in tried]
            cond = lat.cond[left].tolist()
            top = max(cond)
            share = [math.exp(c - top) for c in cond]
            mark, pick = u1 * sum(share), 0
            while pick < len(left) - 1 and mark >= share[pick]:
                mark -= share[pick]
                pick += 1
            tried.add(left[pick])
            others = sum(share) - share[pick] if len(left) > 2 else sum(x for i, x in enumerate(share) if i != pick)
            locs.append(path.before[j] + top + math.log(others) if len(left) > 1 and others > 0 else -np.inf)
            head.append((np.append(path.edges[:j], left[pick]), path.before[:j + 1], path.before[j] + cond[pick], path.words[:j + 1]))
            later = np.arange(w, first_word[d + 1])
            walks.append(later)
            n_walks.append(len(later))
            begin = root[later]
            begin[0] = lat.dst[left[pick]]
            starts.append(begin)
        rest = truncated(np.array(locs), value[docs], uniform(stream(s, 3)[docs], 2 * where + 1))
        for (_, path, j), x in zip(opened, rest.tolist()):
            path.rests[j - path.since] = x
            path.best = None
        extend(s, docs, head, np.concatenate(walks), np.array(n_walks), np.concatenate(starts))
    every = [p for found in paths for p in found]
    ids, n_ids = lat.ids(v, np.concatenate([none, *(p.edges for p in every)]))
    id_at = np.concatenate([[0], np.cumsum(n_ids)])[np.cumsum([0, *(len(p.edges) for p in every)])]
    back = v.bytes_of(ids)
    byte_at = np.concatenate([[0], np.cumsum(v.surface_n[ids])])[id_at]
    out, i = [], 0
    for d, found in enumerate(paths):
        want, rows = normal[d].encode(), []
        for p in found:
            ratio = p.logp - kappa[d]
            incl = 0.0 if ratio > 30 else ratio if ratio < -30 else float(np.log(-np.expm1(-np.exp(ratio))))
            rows.append((ids[id_at[i]:id_at[i + 1]], float(p.logp), float(incl), float(p.value),
                         back[byte_at[i]:byte_at[i + 1]] == want))
            i += 1
        out.append(rows)
    return out


def _units(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``UNIT`` characters."""
    lo = n = 0
    for i, size in enumerate(sizes):
        if n and n + size > UNIT:
            yield lo, i
            lo, n = i, 0
        n += size + 1
    if lo < len(sizes):
        yield lo, len(sizes)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, k: int, seed: int = 0, key_col: str = "doc_id", text_col: str = "text",
           model: str = MODEL, keep: list[str] | None = None, one_row: bool = False) -> DataFrame:
    """Columns ``keep`` (the key by default) and, per sampled segmentation: ``sample``
    (from 0), ``ids``, ``n_pieces``, ``log_prob``, ``log_inclusion``, ``perturbed``,
    ``round_trip``. ``one_row``: one row per text with these of its first segmentation,
    those of the others as structs in the array ``more``. The model file is read on the driver and sent along (its size is
    that of the vocabulary, not of the data)."""
    keep = [key_col] if keep is None else keep
    proto = docs.sparkSession.sparkContext.broadcast(read_model(model))
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
                       F.coalesce(F.concat(F.lit("="), F.col(key_col).cast("string")), F.lit("")).alias("__key"), *keep)
    drawn = StructType.fromDDL("sample int, ids array<int>, n_pieces long, log_prob double, log_inclusion double, "
                               "perturbed double, round_trip boolean")
    more = [StructField("more", ArrayType(drawn))] if one_row else []
    out = StructType(rows.select(*keep).schema.fields + drawn.fields + more)

    def samples(found, since=0):
        rows = [x for xs in found for x in xs]
        number = np.concatenate([np.zeros(0, dtype=np.int32), *(np.arange(since, since + len(xs), dtype=np.int32) for xs in found)])
        size = np.array([len(x[0]) for x in rows], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, dtype=np.int32), *(x[0] for x in rows)])
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, pa.int32()))
        return [pa.array(number, pa.int32()), ids, pa.array(size, pa.int64()), *(pa.array([x[i] for x in rows], pa.float64()) for i in (1, 2, 3)),
                pa.array([bool(x[4]) for x in rows], pa.bool_())]

    def run(batches):
        v = vocabulary(proto.value)
        for b in batches:
            for lo, hi in _units(pc.utf8_length(b.column(0)).to_pylist()):
                texts, keys = (b.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 1))
                found = sample_unit(v, texts, keys, k, seed)
                n, at = np.array([len(xs) for xs in found]), np.arange(lo, hi)
                if one_row:
                    others = pa.StructArray.from_arrays(samples([xs[1:] for xs in found], 1), names=drawn.names)
                    bound = pa.array(np.concatenate([[0], np.cumsum(n - 1)]), pa.int32())
                    columns = [*samples([xs[:1] for xs in found]), pa.ListArray.from_arrays(bound, others)]
                else:
                    at, columns = np.repeat(at, n), samples(found)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns[2:]), *columns], names=out.names)
    return rows.mapInArrow(run, out)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL, out_col: str = "text") -> DataFrame:
    """``encoded`` with ``out_col``: the text its ids stand for (null for null)."""
    proto = encoded.sparkSession.sparkContext.broadcast(read_model(model))
    rows = encoded.drop(out_col)
    at = rows.columns.index(ids_col)

    def run(batches):
        v = vocabulary(proto.value)
        for b in batches:
            texts = [None if x is None else v.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])
    return rows.mapInArrow(run, StructType(rows.schema.fields + [StructField(out_col, StringType())]))


def op7_sample_pieces(spark, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document."""
    return encode(table(spark, sf_dir, "documents"), k=2)
