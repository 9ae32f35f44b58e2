"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a SentencePiece
model (B) cover the same bytes.

A encodes a space and the text, B the text (it adds the space itself), so both cover the
same bytes. The tokenizers' own spans are coarse cuts: A's character offsets where one
token ends and the next begins, B's spans from the proto where they move on. Between two
coarse cuts (pieces of a multibyte character, byte-fallback tokens, which have no span of
their own) the decoded bytes of the tokens give the ends. Ends that both have cut the
tokens into groups; two tokens are linked where their byte ranges overlap, so every
stretch between two ends of either is one link.

Texts are cut at single spaces between characters that are no white space: A's
pre-tokenizer always cuts there, and B does if no piece of its vocabulary has a space
after another character (else texts stay whole). Each distinct part is encoded once per
chunk. A chunk is a run of documents of about ``CHUNK`` characters within a partition. It
has a dictionary of its distinct id pairs, so a pair comes to the corpus-wide count once
per chunk, with the number of the chunk's documents that hold it, and the counts come back
to the chunk once, not once per document.

``align`` gives each document's groups, ``link_counts`` the corpus-wide counts of id
pairs, ``align_counted`` both with sums per document.

Defined results: a null or empty text, or one that the tokens of A or B don't give back
byte by byte (say with U+2581, which B takes for a space), has no tokens: zeros and no
groups. Identifiers may be null or repeated: every row has its result. Long texts are
encoded whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm.common import settle, table

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"

#: Characters of a chunk; a longer text is a chunk alone.
CHUNK = 12 << 20
#: Parts encoded by one call, and parts whose tokens are held as Python objects at once.
JOINED = 256
SLAB = 1 << 15
#: Separators behind a token: in a run, between A and B, between groups, between parts.
SEPARATORS = (",", "|", ";", "\n")

SPLIT = re.compile(r"(?<=\S) (?=\S)")
UNEVEN_SPACE = re.compile(r"\s |^\s| \s|\s$")


def _byte_of_symbol() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1
    stands for itself, the other bytes in order for 256 and on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        symbols = _byte_of_symbol()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.a_bytes[i] = bytes(map(symbols.__getitem__, s))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_n, self.b_n = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        spec = json.loads(byte_bpe)
        splits = spec["pre_tokenizer"] or {}
        self.separable = (splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not spec["normalizer"]
                          and not any(re.search("[^▁]▁", p) for p in pieces))
        n = max(len(self.a_bytes), len(self.b_bytes))
        self.printed = [f"{i}{s}" for i in range(n) for s in SEPARATORS]

    def parts(self, text: str) -> list[str]:
        """The text at single spaces between other characters."""
        if not self.separable:
            return [text]
        return SPLIT.split(text) if UNEVEN_SPACE.search(text) else text.split(" ")


@lru_cache(maxsize=1)
def tokenizers(byte_bpe: str, piece_bpe: bytes) -> Tokenizers:
    return Tokenizers(byte_bpe, piece_bpe)


# --------------------------------------------------------------------- token ends
def _refined(start: np.ndarray, clean: np.ndarray, coarse: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of tokens, and where they disagree with a coarse cut. ``clean`` marks
    tokens with a coarse cut behind them, at byte ``coarse``; ``start`` the byte where
    the encoded text of a token begins. Between cuts the decoded bytes are laid out."""
    if not len(n_bytes):
        return n_bytes, clean[:0]
    run = np.cumsum(n_bytes)
    before = np.where(clean, run, 0)
    last = np.maximum.accumulate(np.where(clean, np.arange(len(run)), -1))
    prev = np.concatenate([[-1], last[:-1]])  # the cut before each token
    new_text = np.concatenate([[True], start[1:] != start[:-1]])
    first = np.maximum.accumulate(np.where(new_text, np.arange(len(run)), 0))
    here = prev >= first  # a cut within the same text; else the text's begin
    base = np.where(here, coarse[prev], start)
    run_base = np.where(here, before[prev], np.where(first > 0, run[first - 1], 0))
    ends = base + run - run_base
    return ends, clean & (ends != coarse)


def _encode(t: Tokenizers, texts: list[str]) -> tuple:
    """Per text whether its tokens give it back; ids, byte ends and text numbers of all
    tokens of A and of B, in the bytes of the texts laid end to end, each behind a space."""
    raw = [(" " + x).encode() for x in texts]
    size = np.array([len(x) for x in raw])
    begin = np.concatenate([[0], np.cumsum(size)])
    ok = np.ones(len(texts), dtype=bool)
    enc = t.a.encode_batch([" " + x for x in texts], add_special_tokens=False)
    n = np.array([len(e.ids) for e in enc])
    a_text = np.repeat(np.arange(len(texts)), n)
    a_ids = np.fromiter((i for e in enc for i in e.ids), np.int64, n.sum())
    span = np.fromiter((x for e in enc for o in e.offsets for x in o), np.int64, 2 * n.sum()).reshape(-1, 2)
    # characters to bytes, over all texts at once
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    byte_of_char = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))
    chars = np.searchsorted(byte_of_char, begin)
    stop = span[:, 1] + chars[a_text]
    follows = np.concatenate([span[1:, 0] + chars[a_text[1:]], stop[-1:]])
    a_ends, off = _refined(begin[a_text], follows >= stop, byte_of_char[stop], t.a_n[a_ids])
    ok[a_text[off]] = False
    enc = t.b.encode(texts, return_type="proto", num_threads=1)
    n = np.array([len(e.pieces) for e in enc])
    b_text = np.repeat(np.arange(len(texts)), n)
    b_ids = np.fromiter((p.id for e in enc for p in e.pieces), np.int64, n.sum())
    stop = np.fromiter((p.end for e in enc for p in e.pieces), np.int64, n.sum()) + 1  # the space that B adds
    moves = np.concatenate([[True][:len(stop)], (stop[1:] > stop[:-1]) | (b_text[1:] != b_text[:-1])])
    moves &= stop > 1  # the added space alone has no span of its own
    b_ends, off = _refined(begin[b_text], moves, stop + begin[b_text], t.b_n[b_ids])
    ok[b_text[off]] = False
    for ids, text, table_ in ((a_ids, a_text, t.a_bytes), (b_ids, b_text, t.b_bytes)):
        if b"".join(map(table_.__getitem__, ids.tolist())) != b"".join(raw):
            cut = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            back = list(map(table_.__getitem__, ids.tolist()))
            ok &= [b"".join(back[i:j]) == x for i, j, x in zip(cut, cut[1:], raw)]
    return ok, size, (a_ids, a_ends, a_text), (b_ids, b_ends, b_text)


def _links(t: Tokenizers, size: np.ndarray, a: tuple, b: tuple) -> tuple:
    """Of parts that the tokens give back (``size`` bytes each, with the space before):
    per part the groups printed, the numbers of tokens of A and B, of groups and of links,
    and all links as pairs ``A id << 32 | B id`` in order."""
    (a_ids, a_ends, _), (b_ids, b_ends, _) = a, b
    stops = np.cumsum(size)
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)
    ends = np.union1d(a_ends, b_ends)
    pairs = a_ids[np.searchsorted(a_ends, ends)] << 32 | b_ids[np.searchsorted(b_ends, ends)]
    count = lambda x: np.diff(np.searchsorted(x, stops, side="right"), prepend=0)
    # tokens in the order of printing: by group, A before B
    group = np.concatenate([np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)])
    kind = np.repeat([0, 1], [len(a_ids), len(b_ids)])
    order = np.lexsort((kind, group))
    g, k = group[order], kind[order]
    last = np.append(np.diff(g) != 0, True)
    sep = np.where(last, 2, np.append(np.diff(k) != 0, False))
    text_of = np.searchsorted(stops, both[g]) if len(g) else g
    sep[last & np.append(np.diff(text_of) != 0, True)] = 3
    tokens = np.concatenate([a_ids, b_ids])[order] * len(SEPARATORS) + sep
    printed = "".join(map(t.printed.__getitem__, tokens.tolist())).split("\n")[:-1]
    return printed, count(a_ends), count(b_ends), count(both), count(ends), pairs


class Parts:
    """Distinct parts of texts with their groups and links."""

    def __init__(self, t: Tokenizers) -> None:
        self.t = t
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.printed: list[str | None] = []
        self.counts: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links, per part
        self.pairs: list[np.ndarray] = []

    def take(self, text: str) -> np.ndarray:
        parts = self.t.parts(text)
        return np.fromiter(map(self.number.__getitem__, parts), np.int32, len(parts))

    def encode(self) -> None:
        """Tokens of the parts that have none yet, a bounded number at once."""
        new = list(self.number)[len(self.printed):]
        for lo in range(0, len(new), SLAB):
            self._slab(new[lo:lo + SLAB])

    def _slab(self, parts: list[str]) -> None:
        edged = [not p or p[0].isspace() or p[-1].isspace() for p in parts]
        joined, members, open_ = [], [], []
        for i, alone in enumerate(edged):
            if alone or not self.t.separable:
                joined.append(parts[i])
                members.append([i])
            else:
                open_.append(i)
                if len(open_) == JOINED:
                    joined.append(" ".join(parts[j] for j in open_))
                    members.append(open_)
                    open_ = []
        if open_:
            joined.append(" ".join(parts[j] for j in open_))
            members.append(open_)
        printed: list[str | None] = [None] * len(parts)
        counts = np.zeros((len(parts), 4), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        again = self._some(parts, joined, members, printed, counts, found)
        if again:  # texts that don't come back: part by part
            self._some(parts, [parts[i] for i in again], [[i] for i in again], printed, counts, found)
        self.printed += printed
        self.counts.append(counts)
        owner = np.concatenate([np.repeat(i, n) for i, n, _ in found]) if found else np.zeros(0, dtype=np.int64)
        pairs = np.concatenate([p for _, _, p in found]) if found else np.zeros(0, dtype=np.int64)
        order = np.argsort(owner, kind="stable")
        self.pairs.append(pairs[order])

    def _some(self, parts, joined, members, printed, counts, found) -> list[int]:
        ok, size, a, b = _encode(self.t, joined)
        again = [i for good, m in zip(ok.tolist(), members) if not good and len(m) > 1 for i in m]
        if not ok.all():  # leave out what failed, and close the gaps
            shift = np.concatenate([[0], np.cumsum(np.where(ok, 0, size))])
            a, b = (tuple(x[ok[text]] for x in (ids, ends - shift[text], text)) for ids, ends, text in (a, b))
        good = [m for m, fine in zip(members, ok.tolist()) if fine]
        if good:
            owner = np.array([i for m in good for i in m])
            bytes_ = np.array([len(parts[i].encode()) + 1 for i in owner.tolist()])
            texts, n_a, n_b, n_g, n_l, pairs = _links(self.t, bytes_, a, b)
            for i, x in zip(owner.tolist(), texts):
                printed[i] = x
            counts[owner] = np.stack([n_a, n_b, n_g, n_l], axis=1)
            found.append((owner, n_l, pairs))
        return again

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts per part, distinct pairs (sorted), the links of all parts as places in
        them, and where each part's links begin."""
        counts = np.concatenate([np.zeros((0, 4), dtype=np.int64), *self.counts])
        distinct, links = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *self.pairs]), return_inverse=True)
        return counts, distinct, links.astype(np.int32), np.concatenate([[0], np.cumsum(counts[:, 3])])


def _ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of every run."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


# ------------------------------------------------------------------------- chunks
def _whole(printed: str) -> str:
    return printed


def _sha256(printed: str) -> str:
    return hashlib.sha256(printed.encode()).hexdigest() if printed else ""


def chunks(docs: DataFrame, id_col: str, text_col: str, byte_bpe: str, piece_bpe: str,
           render: Callable[[str], str]) -> DataFrame:
    """Three kinds of rows per ``chunk``: documents (``id``, ``numbers``, ``groups`` as
    ``render`` gives them, ``parts``: the numbers of the text's parts), parts (``parts``:
    how many links each of a slab has, ``links``: these, ``numbers``: the slab's) and pairs (``pairs`` with the
    number of the chunk's documents that hold them, ``held``)."""
    with open(byte_bpe, encoding="utf-8") as a, open(piece_bpe, "rb") as b:
        model = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))  # the vocabularies' size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = (f"chunk long, kind int, id {kind}, numbers array<long>, groups string, parts array<int>, "
              "links array<int>, pairs array<long>, held array<long>")
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def batch(id_type, chunk, kind, **cols):
        n = len(next(iter(cols.values())))
        types = {"id": id_type, "numbers": longs, "groups": pa.string(), "parts": ints, "links": ints, "pairs": longs, "held": longs}
        arrays = [pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in types.items()]
        return pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array([kind] * n, pa.int32()), *arrays],
                                          names=["chunk", "kind", *types])

    def finished(chunk: int, known: Parts, id_type, ids: list, taken: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        known.encode()
        counts, distinct, links, begin = known.tables()
        held = np.zeros(len(distinct), dtype=np.int64)
        good = np.array([p is not None for p in known.printed], dtype=bool)
        lo = 0
        while lo < len(taken):
            numbers, groups, hi, n = [], [], lo, 0
            while hi < len(taken) and n < 1 << 21:
                x = taken[hi]
                if len(x) and good[x].all():
                    numbers.append(counts[x].sum(axis=0))
                    groups.append(render(";".join(map(known.printed.__getitem__, x.tolist()))))
                    own = np.unique(x)
                    held[np.unique(links[_ragged(begin[own], counts[own, 3])])] += 1
                else:
                    numbers.append(np.zeros(4, dtype=np.int64))
                    groups.append(render(""))
                    taken[hi] = x[:0]
                n += len(x) + len(groups[-1]) // 8
                hi += 1
            yield batch(id_type, chunk, 0, id=ids[lo:hi], numbers=numbers, groups=groups, parts=taken[lo:hi])
            lo = hi
        for i in range(0, len(counts), SLAB):
            j = min(i + SLAB, len(counts))
            yield batch(id_type, chunk, 1, numbers=[[i]], parts=[counts[i:j, 3].astype(np.int32)], links=[links[begin[i]:begin[j]]])
        for i in range(0, len(distinct), SLAB):
            yield batch(id_type, chunk, 2, pairs=[distinct[i:i + SLAB]], held=[held[i:i + SLAB]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(*model.value)
        part = TaskContext.get().partitionId()
        known, ids, taken, size, n = Parts(t), [], [], 0, 0
        gc.disable()  # millions of small objects that hold no cycles
        try:
            for b in batches:
                id_type = b.column(0).type
                for x, text in zip(*b.columns):
                    text = text.as_py() or ""
                    if taken and size + len(text) > CHUNK:
                        yield from finished(part << 32 | n, known, id_type, ids, taken)
                        known, ids, taken, size, n = Parts(t), [], [], 0, n + 1
                    ids.append(x.as_py())
                    taken.append(known.take(text) if text else np.zeros(0, dtype=np.int32))
                    size += len(text)
            if taken:
                yield from finished(part << 32 | n, known, id_type, ids, taken)
        finally:
            gc.enable()
    return rows.mapInArrow(run, schema)


def _pair_counts(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks' pairs, and the corpus-wide count of each pair (``best``: its A id has
    no pair with a higher one)."""
    here = made.filter("kind = 2").select("chunk", F.explode(F.arrays_zip("pairs", "held")).alias("x")) \
        .select("chunk", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = here.groupBy("pair").agg(F.sum("held").alias("count"))
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("count").alias("top"))  # a row per id of A's vocabulary
    return here, counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
          piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Per document ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups``
    (A and B ids: ``a1,a2|b1;a3|b2,b3``)."""
    made = chunks(docs, id_col, text_col, byte_bpe, piece_bpe, _whole)
    return made.filter("kind = 0").select(
        F.col("id").alias(id_col), *[F.col("numbers")[i].alias(c) for i, c in enumerate(["n_a", "n_b", "n_groups", "n_links"])], "groups")


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
                piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Per linked id pair ``a``, ``b``: in how many documents they are linked, and
    whether ``a`` has no partner with more."""
    made = settle(chunks(docs, id_col, text_col, byte_bpe, piece_bpe, _sha256), "chunks")
    return _pair_counts(made)[1].filter("count > 0").select(F.shiftright("pair", 32).alias("a"),
                                        F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "count", "best")


def align_counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
                  piece_bpe: str = PIECE_BPE, digest: bool = False) -> DataFrame:
    """``align`` with, over the links of each document, ``n_best`` (whose count is the
    highest of their A id) and ``count_sum``; ``digest``: the groups' SHA-256."""
    made = settle(chunks(docs, id_col, text_col, byte_bpe, piece_bpe, _sha256 if digest else _whole), "chunks")
    here, counts = _pair_counts(made)
    back = here.join(counts, "pair").select(F.col("chunk").alias("of"), "pair", "count", "best")
    rows = made.filter("kind < 2").select("chunk", "kind", "id", "numbers", "groups", "parts", "links")
    kind = rows.schema["id"].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        """Rows and pairs of one chunk, which is bounded by its characters."""
        left, right = left.combine_chunks(), right.combine_chunks()
        order = np.argsort(right.column("pair").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        flat = lambda t, c: pc.list_flatten(t.column(c)).to_numpy()
        slabs = left.filter(pc.equal(left.column("kind"), 1))
        slabs = slabs.take(pa.array(np.argsort(flat(slabs, "numbers"))))
        n, links = flat(slabs, "parts"), flat(slabs, "links")
        stop = np.cumsum(n)
        docs_ = left.filter(pc.equal(left.column("kind"), 0))
        at, ends = flat(docs_, "parts"), np.cumsum(pc.list_value_length(docs_.column("parts")).to_numpy())
        per_doc = []
        for value in (best, count):
            run = np.concatenate([[0], np.cumsum(value[links] if len(value) else links)])
            per_part = run[stop] - run[stop - n]
            run = np.concatenate([[0], np.cumsum(per_part[at])])
            per_doc.append(np.diff(run[ends], prepend=0))
        numbers = flat(docs_, "numbers").reshape(-1, 4)
        return pa.table([docs_.column("id"), *(pa.array(x) for x in [*numbers.T, *per_doc]), docs_.column("groups")],
                        names=["id", *names, "groups"])
    out = rows.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(
        summed, f"id {kind}, " + ", ".join(f"{c} long" for c in names) + ", groups string")
    return out.withColumnRenamed("id", id_col)


def op11_align_tokens(spark, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers on all documents."""
    return align_counted(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
