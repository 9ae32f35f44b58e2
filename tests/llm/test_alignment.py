"""Token alignment against brute force over bytes."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from runfold.llm import alignment
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, id long, chunk string, kind string, groups string"
A = Tokenizer.from_file(alignment.BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
SYMBOL = alignment._byte_of_symbol()


def tokens(text):
    """Whole text by both tokenizers: ids and bytes, or None."""
    if not text:
        return None
    want = (" " + text).encode()
    e = A.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(SYMBOL[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else None


def by_hand(rows):
    """rows: (key, text). Per key the numbers and groups."""
    out, links, held = {}, {}, Counter()
    for n, (key, text) in enumerate(rows):
        got = tokens(text)
        groups, pairs = [], []
        if got:
            owner = [[i for i, (_, x) in enumerate(side) for _ in x] for side in got]
            pairs = [(got[0][i][0], got[1][j][0]) for i, j in sorted(set(zip(*owner)))]
            cut = 0
            for at in range(1, len(owner[0]) + 1):
                if at == len(owner[0]) or all(o[at] != o[at - 1] for o in owner):
                    groups.append("|".join(",".join(str(side[i][0]) for i in sorted(set(o[cut:at]))) for side, o in zip(got, owner)))
                    cut = at
        out[n] = [key, len(got[0]) if got else 0, len(got[1]) if got else 0, len(groups), len(pairs)]
        links[n] = (pairs, ";".join(groups))
        held.update(set(pairs))
    best = defaultdict(int)
    for (a, _), c in held.items():
        best[a] = max(best[a], c)
    rows_ = [(*out[n], sum(held[p] == best[p[0]] for p in links[n][0]), sum(held[p] for p in links[n][0]), links[n][1]) for n in out]
    return rows_, {(a, b, c, c == best[a]) for (a, b), c in held.items()}


TEXTS = [
    None, "", " ", "   ", "\n", "plain words only", " leading", "trailing ", "two  spaces", "tab\t and\nnew \n line", "a" * 3000,
    "naïve 日本語 \U0001d4b3z \U0001f469‍\U0001f469‍\U0001f467 é", "\U0001d4b3", "x▁y z", "▁", "<0x41> <s> </s> <|endoftext|> [INST]",
    "don't we'll I'd 12345 3.14 #$%", "\x00 \x01\x1c \x85   　 ﻿", "same text here", "same text here", "a\r\nb \r c;\r d",
    "क्ष ภาษา العربية", "word " * 5000 + "end",
]


@pytest.mark.parametrize("chunk, joined, slab", [(1 << 20, 256, 1 << 15), (40, 2, 3), (1, 1, 1)])
def test_edges_by_hand(spark, monkeypatch, chunk, joined, slab):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "JOINED", joined)
    monkeypatch.setattr(alignment, "SLAB", slab)
    rows = [(None if i == 7 else 5 if i == 9 else i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, 1, "c", None, "g") for i, t in rows], DOCS).repartition(3)
    want, counts = by_hand(rows)
    out = alignment.align_counted(docs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, alignment.align(docs).collect()), key=key) == sorted([(*r[:5], r[7]) for r in want], key=key)
    assert {tuple(r) for r in alignment.link_counts(docs).collect()} == counts


def test_whole_texts_where_parts_are_not_separable(spark, monkeypatch):
    monkeypatch.setattr(alignment.Tokenizers, "parts", lambda self, text: [text])
    t = alignment.Tokenizers(open(alignment.BYTE_BPE).read(), open(alignment.PIECE_BPE, "rb").read())
    assert t.separable
    t.separable = False
    known = alignment.Parts(t)
    texts = [x for x in TEXTS if x]
    taken = [known.take(x) for x in texts]
    known.encode()
    want = {r[0]: r[7] for r in by_hand(list(enumerate(texts)))[0]}
    assert [known.printed[x[0]] or "" for x in taken] == [want[i] for i in range(len(texts))]


def test_query_by_hand(spark):
    import __spark_entry__ as e
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = {(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in by_hand(rows)[0]}
    out = e.queries()["op11_align_tokens"](spark, SF_SMALL)
    assert out.columns[-1] == "groups_sha256"
    assert {tuple(r) for r in out.collect()} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert alignment.align_counted(docs).count() == 0 and alignment.link_counts(docs).count() == 0
