"""Chat formatting and quality rules against their SQL and on small cases."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runfold.llm import chat, quality
from tests.conftest import SF_SMALL
from tests.llm.compare import compare


@pytest.mark.parametrize("key", ["op3_format_chats", "op10_quality_rules"])
def test_matches_sql(spark, duck_small, key):
    r = compare(spark, duck_small, key, SF_SMALL)
    assert r["ok"], r


TURNS = "conv_id long, turn long, role string, text string, segments string"


def test_round_trip_of_hostile_texts(spark):
    bits = ["</s>", "<\\/s>", "<\\\\/s>", "[INST]", "[\\/INST]", "[/INST]", "[OUT] ", " [/ROLE]", "[ROLE] ", "\\", "<", "[", "\n",
            "é", " ", "", "[/SYS]", "s>", "/s>", "[/TURN]", "<s>"]
    data, want = [], {}
    for i in range(200):
        for t in range(1 + i % 4):
            text = "".join(bits[(i * 7 + t * 3 + k * (i % 5 + 1)) % len(bits)] for k in range(i % 6))
            role = ["user", "assistant", "system", "tool [/ROLE]", None, "x\\"][(i + t) % 6]
            data.append((i, t, role, text if text or i % 2 else None, "clash"))
            want.setdefault(i, []).append((role or "", text))
    out = chat.format_chats(spark.createDataFrame(data, TURNS).repartition(4))
    for r in out.select("conv_id", "formatted", "segments", chat.read_back(F.col("formatted")).alias("back")).collect():
        assert [tuple(x) for x in r.back] == want[r.conv_id], r.formatted
        assert "".join(s.text for s in r.segments) == r.formatted
        assert sum(s.loss for s in r.segments) == sum(role == "assistant" for role, _ in want[r.conv_id])


def test_machine(spark):
    cases = {1: "system user assistant user assistant", 2: "user user", 3: "assistant", 4: "user assistant system",
             5: "user", 6: "user robot assistant"}
    data = [(c, t, role, "x", None) for c, roles in cases.items() for t, role in enumerate(roles.split())]
    out = {r.conv_id: (r.valid, r.last_state, r.bad_turn)
           for r in chat.format_chats(spark.createDataFrame(data, TURNS)).collect()}
    assert out == {1: (True, "assistant", -1), 2: (False, "user", 1), 3: (False, "start", 0), 4: (False, "assistant", 2),
                   5: (True, "user", -1), 6: (False, "user", 1)}


def test_chat_empty_and_null_keys(spark):
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0
    data = [(None, None, None, None, None), (None, 1, "user", "b", None), (None, 1, "user", "b", None)]
    out = chat.format_chats(spark.createDataFrame(data, TURNS)).collect()
    assert len(out) == 1 and out[0].formatted == "[ROLE]  [/ROLE][/TURN][INST] b [/INST][INST] b [/INST]"


def by_hand(text):
    t = text or ""
    w = t.replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    rep = {j for s in seen.values() if len(s) > 1 for i in s for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))


DOCS = "doc_id long, text string, lang string, quality string"


def run(spark, texts):
    df = quality.measures(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS))
    return [r.quality for r in df.orderBy("doc_id").collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab c\n\t#|.é\x0b", max_size=60)), min_size=1, max_size=40))
def test_base_counts_by_hand(spark, texts):
    for t, q in zip(texts, run(spark, texts)):
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == by_hand(t), repr(t)


def test_verdicts(spark):
    prose = "\n".join(f"The {hashlib.md5(str(i).encode()).hexdigest()} river runs {i} miles past hill number {i}." for i in range(20))
    menu = "\n".join(f"Home {i} | About {i} | Contact {i} | News {i}" for i in range(60))
    noise = "\n".join(f"wo{i}### rd{i}$$$ is{i}%%% here{i}&&& now{i}*** so{i}&&&" for i in range(30))
    shout = "\n".join(f"BUY{i}!! IT{i}!! NOW{i}!! OR{i}!! CRY{i}!!" for i in range(30))
    loop = "one two three. " * 40
    cut = " ".join(f"word{i}" for i in range(200))
    out = run(spark, [prose, menu, noise, shout, loop, cut, None, "", prose + "\nAccept cookies now.", prose * 200])
    assert [q.kept for q in out] == [True, False, False, False, False, True, False, False, True, False]
    assert "cookies" not in out[8].clean_text and out[8].clean_text == prose
    docs = spark.createDataFrame([(1, prose, "en", None), (2, menu, "en", None)], DOCS)
    left = quality.clean(docs)
    assert left.columns == ["doc_id", "text", "lang", "quality"] and [r.doc_id for r in left.collect()] == [1]
    assert quality.measures(spark.createDataFrame([], DOCS)).count() == 0


def test_any_column_names(spark):
    names = ["doc_id", "text", "quality", "__l", "__w", "__c", "in0", "measured", "a.b"]
    text = "\n".join(f"The {hashlib.md5(str(i).encode()).hexdigest()} river runs {i} miles past hill number {i}." for i in range(20))
    docs = spark.createDataFrame([(1, text, 0, "l", "w", "c", "i", "m", "d")], names)
    got = quality.measures(docs)
    assert got.columns == [n for n in names if n != "quality"] + ["quality"] and got.first().quality.n_words == 200
    assert quality.clean(docs).columns == names and tuple(quality.clean(docs).first()) == tuple(docs.first())
