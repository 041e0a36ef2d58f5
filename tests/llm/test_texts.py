import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxmeter.llm import tokenizer as K
from boxmeter.llm import truncation as X

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def encoder():
    with open(K.vocabulary_path(), "rb") as f:
        return K.Encoder(f.read())


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(encoder, texts):
    ids, counts, _ = encoder.encode(texts)
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


PIECES = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "\xa0", "a", "é", "Ж", "1", "٣", "½", "!", "—", "👍", "中", "\u200b", "e\u0301", "\x1c", "\x85", "\u2009", "'ve", "'S", "<|endoftext|>", "ª", "ⅷ"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join) | st.text(max_size=20), max_size=6))
def test_ids_and_round_trip(texts):
    with open(K.vocabulary_path(), "rb") as f:
        e = K._encoder(f.read())
    import public_tokenizers as P

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")) if not hasattr(test_ids_and_round_trip, "t") else test_ids_and_round_trip.t
    t.encode_special_tokens = True
    test_ids_and_round_trip.t = t
    got = ids_of(e, texts)
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [e.decode(i).decode() for i in got] == texts


def test_long_runs_and_offsets(encoder, reference):
    for text in ("x" * 30000, " " * 5000 + "end", "ab'" * 9000, "é" * 700):
        got = ids_of(encoder, [text])[0]
        assert got == reference.encode(text, add_special_tokens=False).ids
    texts = ["héllo wörld", "", "a  b'll\n\nЖук 12"]
    ids, counts, starts = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        data, begin = text.encode(), starts[at : at + n].tolist()
        assert [data[a:b] for a, b in zip(begin, [*begin[1:], len(data)])] == [encoder.decode([i]) for i in ids[at : at + n].tolist()]
        at += n


def test_table(spark, encoder):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, "a b")], "doc_id long, text string").selectExpr("*", "'x' AS id", "'y' AS out")
    rows = sorted((r.doc_id, r.ids) for r in K.encode(df).collect())
    assert rows == [(1, ids_of(encoder, ["a b"])[0]), (2, []), (3, []), (3, ids_of(encoder, ["a b"])[0])]
    assert K.encode(df.filter("false")).count() == 0


PARTS = ["left door", "rear window", "front bumper", "tail lamp", "side sill", "quarter panel"]
STATES = ["badly scratched", "freshly cleaned", "still wet", "partly hidden"]


def sentence(r):
    return r.choice(
        [
            lambda: f"Photo {r.randrange(900)} is {r.choice(STATES)}, so the box on the {r.choice(PARTS)} was widened.",
            lambda: f"The assessor measured {r.randrange(900)} mm on the {r.choice(PARTS)} after the wash.",
            lambda: f'The customer says "{r.choice(STATES)}" but the {r.choice(PARTS)} looks fine to us!',
            lambda: f"Length approx. {r.randrange(90)} cm, see sheet K{r.randrange(10000, 99999)}.",
        ]
    )()


def test_cut_texts_are_found(spark):
    r = random.Random(6)
    rows, cut, whole = [], set(), set()
    for i in range(1200):
        t = " ".join(sentence(r) for _ in range(r.randint(2, 4)))
        if i % 6 == 0:
            last = t.rstrip(".!").rfind(". ") + 2
            at = r.randrange(max(last + 12, len(t) - 40), len(t) - 6)
            t = t[:at].rstrip() + ("…", "...", "", " [...]")[i % 4]
            cut.add(i)
        elif i % 6 == 1:
            t = t.rstrip(".!")
            whole.add(i)
        elif i % 6 == 2:
            t = t.rstrip(".!") + "..."
            whole.add(i)
        else:
            whole.add(i)
        rows.append((i, t, ("Note ", "note", "NO-TE", None)[i % 4]))
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, " \n", "x"), (5003, '{"a": [1, 2', "x"), (5004, '{"a": [1, 2]}', "x"), (5005, "```json\n{}", "x")]
    rows += [(6000 + i, rows[1][1], "x") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS head", "2 AS reason")
    got = {row.doc_id for row in X.truncated(df).collect()}
    assert not got & (whole | {5000, 5001, 5002, 5004} | set(range(6000, 6005)))
    assert {5003, 5005} <= got and len(got & cut) > 0.9 * len(cut)
    rates = {row.source: (row.n_texts, row.n_cut) for row in X.rates(df, X.truncated(df)).collect()}
    assert rates["note"][0] == 600 and rates["x"] == (8, 2)


def test_few_and_no_texts(spark):
    schema = "doc_id long, text string, source string"
    assert X.truncated(spark.createDataFrame([], schema)).count() == 0
    assert X.truncated(spark.createDataFrame([(1, "only one text here", "x"), (2, "w" * 200000, "x"), (3, "?", "x")], schema)).count() == 0


@pytest.mark.parametrize(
    "text,last",
    [
        ("a b c" + " .." * 30000, "c"), ("a b c" + "\n-- x" * 30000, "c"), ("a" + " " * 100000 + "b.", "b"), ("a" + " \n" * 50000 + "b c", "c"), ("x" * 200000, "x" * 200000), ("1." * 50000 + "1", "0"),
        ("?!" * 50000, None), ("a " + "[..] " * 20000, "a"), ("a \x1e b", "b"),
    ],
)
def test_extreme_texts_end_where_they_end(spark, text, last):
    df = spark.createDataFrame([(1, text), (2, "fine text here.")], "doc_id long, text string")
    assert {r.doc_id: r.c for r in X.endings(df).collect()} == {2: "here"} | ({1: last} if last else {})
